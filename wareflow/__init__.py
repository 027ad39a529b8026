"""wareflow: catalogue and review analytics as PySpark DataFrame operators."""
