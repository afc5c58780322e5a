"""chunkloom: a Spark-native engine for indexing and retrieving code and documents.

Everything is expressed as lazy DataFrame plans.  Subpackages:

* ``sources``    directory scan data source, text decoding, log tail, PDF pages
* ``functions``  column functions (hash ids, text, chapters, references, vectors)
* ``chunking``   one-file-to-many-chunks table functions
* ``operators``  joins, windows, search, upsert planning, orphan references
* ``plans``      the registered core queries and their oracle SQL
* ``streaming``  incremental indexing with Structured Streaming
* ``llm``        optional training-data operators (nothing else imports it)
"""

__version__ = "0.1.0"
