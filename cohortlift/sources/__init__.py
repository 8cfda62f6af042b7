"""Where the clinical star is read from and where tables and results are written."""
