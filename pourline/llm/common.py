"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A-Z to a-z and nothing else; other letters keep their case.
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_LOWER_BYTES = bytes(LOWER.get(c, c) for c in range(256))


def lower_ascii(text: str) -> str:
    """Lower-case A-Z only (UTF-8 keeps every other character out of A-Z)."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER_BYTES).decode("utf-8", "surrogatepass")


def words_of(text: str) -> list[str]:
    """The words of a text after lower-casing A-Z."""
    return WORD.findall(lower_ascii(text))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where the session names none, a temporary folder is set for it if all tasks run on
    this machine (local tests); on a cluster that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def durable_alone(df: DataFrame) -> DataFrame:
    """As durable, and the shuffle files from which the checkpoint was made go at once, not when the driver collects garbage.

    Where many checkpoints follow each other, their shuffles else lie on the disks together.
    """
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        # The setting holds for frames that are made under it.
        return durable(df.select("*"))
    finally:
        conf.set(key, before)


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder; it is made by its first writer."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def keep_ids(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id", how: str = "left_semi") -> DataFrame:
    """Rows of docs whose id is (or is not) in the one-column frame ids; all columns of docs stay."""
    only = ids.select(F.col(ids.columns[0]).alias("__kept_id"))
    return docs.join(only, docs[doc_id] == only["__kept_id"], how)
