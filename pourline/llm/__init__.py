"""Operators that prepare text corpora for language-model training.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrame to DataFrame that names the columns it reads; other columns of the
input are ignored, so extra columns may carry any name.
"""
