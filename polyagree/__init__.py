"""polyagree: agreement of independent sources about short multilingual texts, on PySpark."""
