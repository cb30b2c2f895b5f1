"""scoutline: document indexing and candidate/company matching on Spark.

Every public operator is either ``Column -> Column`` (``scoutline.functions``)
or ``DataFrame -> DataFrame`` (``scoutline.operators``, ``scoutline.sources``,
``scoutline.streaming``).  Nothing collects rows to the driver; clocks and
seeds are arguments so that reruns repeat.
"""

__version__ = "0.1.0"
