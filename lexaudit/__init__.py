"""lexaudit: keyword statistics and URL audit tables over a web page archive,
written as PySpark DataFrame jobs.

Sub-packages:

* ``functions`` -- column expressions (``Column -> Column``), no shuffles.
* ``operators`` -- DataFrame -> DataFrame stages (joins, windows, aggregates).
* ``sources``   -- readers, writers and inputs derived from the driver tables.
* ``plans``     -- end-to-end jobs and the registered queries.
* ``streaming`` -- the per-row stages run on ``readStream``.
"""

from lexaudit.settings import Settings

__all__ = ["Settings"]
