"""Audit operators for large collections of documents, source trees and table catalogs.

Every operator takes DataFrames and returns DataFrames. See README.md for the map of modules.
"""

__version__ = "0.1.0"
