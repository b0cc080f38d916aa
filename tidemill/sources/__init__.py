"""Sources and sinks: directories of CSV and XLSX files, and the six artifacts."""
