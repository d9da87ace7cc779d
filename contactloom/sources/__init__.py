"""File readers, format dispatch and the XLSX data source."""
