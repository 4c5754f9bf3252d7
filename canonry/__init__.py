"""canonry: canonical-name standardisation as Spark jobs.

Every operator is a ``DataFrame -> DataFrame`` or ``Column -> Column``
function. Sub-packages:

* ``functions``  scalar Column expressions (text, vectors, arrays, JSON)
* ``sources``    readers and writers (nested JSON, CSV, Parquet, reports, models)
* ``operators``  labels, lookups, classifiers, similarity search, translation, metrics, serving
* ``streaming``  Structured Streaming scoring
* ``plans``      the registered queries and their DuckDB oracle SQL
"""

__version__ = "0.1.0"
