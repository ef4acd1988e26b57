"""Files: codecs, the TIFF structure, and Spark data sources that read and write it."""
