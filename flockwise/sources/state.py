"""The engine's state: cursors and times in one small file that is replaced in one step."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class State:
    """Everything that a later run needs of the earlier ones; `version` names the data directory that counts."""

    version: int = 0
    last_status_id: int = 0
    last_favourite_id: int = 0
    last_bookmark_id: int = 0
    last_block_id: int = 0
    last_mute_id: int = 0
    last_mention_id: int = 0
    last_follow_id: int = 0
    last_interaction_status_id: int = 0
    last_interaction_favourite_id: int = 0
    last_stats_status_id: int = 0
    last_activity_account_id: int = 0
    last_feed_user_id: int = 0
    embedding_signature: str = ""
    similarity_signature: str = ""
    last_rebuild_at: str = ""
    updated_at: str = ""

    def advanced(self, **to: int | str) -> State:
        """Cursors only move forward; texts are replaced."""
        return replace(self, **{k: max(getattr(self, k), v) if isinstance(v, int) else v for k, v in to.items()})


def _paths(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def load_state(spark: SparkSession, path: str) -> State:
    """The state in a file on any file system Spark knows; the initial state if there is none. Unknown fields are dropped."""
    _, fs, place = _paths(spark, path)
    if not fs.exists(place):
        return State()
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    known = {f.name for f in fields(State)}
    return State(**{k: v for k, v in json.loads(text).items() if k in known})


def save_state(spark: SparkSession, path: str, state: State) -> None:
    """Writes a new file beside the old one and renames it over; data versions must be written before."""
    jvm, fs, place = _paths(spark, path)
    fresh = jvm.org.apache.hadoop.fs.Path(path + ".new")
    out = fs.create(fresh, True)
    out.write(bytearray(json.dumps(asdict(state), indent=1).encode()))
    out.close()
    options = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    array = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    array[0] = options
    context.rename(fs.makeQualified(fresh), fs.makeQualified(place), array)
