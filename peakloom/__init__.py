"""peakloom: LC-MS peak analytics on PySpark DataFrames."""
