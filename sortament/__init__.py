"""sortament: a PySpark engine for price lists, catalogues and text corpora.

Subpackages
-----------
functions   column expressions (all JVM-side unless a docstring says otherwise)
sources     readers and writers
operators   DataFrame -> DataFrame operators
plans       registered queries and their SQL counterparts
streaming   Structured Streaming forms of the incremental operators
llm         operators for training data; nothing else imports it
"""

__version__ = "0.1.0"
