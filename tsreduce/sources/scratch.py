"""What a computation keeps between its rounds, and gives back."""

from __future__ import annotations

import uuid
from collections import Counter
from threading import Lock

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset and all runs on this machine, one beside the warehouse."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder there that all its machines share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"


#: How many scratches of this process hold a frame, by what it computes: Spark keeps frames that compute the same only once.
_holders: Counter = Counter()
_lock = Lock()


class Scratch:
    """Frames in memory and tables in the shared folder that go when it is closed. A table cuts the lineage of a round."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._kept, self._paths = spark, [], []

    def keep(self, df: DataFrame) -> DataFrame:
        """df, held in memory and on disk once it has been computed."""
        with _lock:
            _holders[key := (id(self.spark), df.semanticHash())] += 1
            self._kept.append((df.persist(StorageLevel.MEMORY_AND_DISK), key))
        return df

    @staticmethod
    def _give_back(df: DataFrame, key: tuple) -> None:
        with _lock:
            _holders[key] -= 1
            if not _holders[key]:
                del _holders[key]
                df.unpersist()

    def store(self, df: DataFrame) -> DataFrame:
        """df as a table that has been written and is read again."""
        path = f"{shared_folder(self.spark)}/tsreduce-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self._paths.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        """Gives back what keep or store has returned, before the rest."""
        for df in frames:
            if df is None:
                continue
            if (path := getattr(df, "_scratch", None)) in self._paths:
                self._delete(path)
                self._paths.remove(path)
            for held in [h for h in self._kept if h[0] is df]:
                self._kept = [h for h in self._kept if h is not held]
                self._give_back(*held)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def close(self) -> None:
        for held in self._kept:
            self._give_back(*held)
        for path in self._paths:
            self._delete(path)
        self._kept, self._paths = [], []

    def adopt(self, other: Scratch) -> None:
        """Takes over what other holds."""
        self._kept += other._kept
        self._paths += other._paths
        other._kept, other._paths = [], []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()
