"""Folder intake as a stream that ends when no file is left."""
