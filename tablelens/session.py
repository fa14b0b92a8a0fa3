"""Session defaults and reliable checkpoints."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_type

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "tablelens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this library's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def pin_session(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on to a session made elsewhere."""
    for key, value in DEFAULT_CONF.items():
        spark.conf.set(key, value)
    return spark


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so lost executors cost no recomputation.

    The folder is the session's ``spark.checkpoint.dir``. Only a local session may go
    without one; it then gets a scratch folder.
    """
    context = df.sparkSession.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir")
    if configured:
        if not context.getCheckpointDir():
            context.setCheckpointDir(configured)
    elif not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tablelens-checkpoint-"))
    return df.checkpoint(eager=True)


def small_table(spark: SparkSession, records: Sequence[tuple], schema: str) -> DataFrame:
    """A handful of driver-made rows (bounded by columns or parameters) as a local relation.

    Arrow keeps it inside the JVM plan, with known size and without Python workers.
    """
    fields = T.StructType.fromDDL(schema)
    columns = list(zip(*records)) if records else [()] * len(fields)
    arrays = [pa.array(list(values), type=to_arrow_type(f.dataType)) for values, f in zip(columns, fields)]
    return spark.createDataFrame(pa.table(arrays, names=fields.names), fields)
