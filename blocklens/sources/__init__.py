"""Image content as rows: format detection, header decoding and a file source."""
