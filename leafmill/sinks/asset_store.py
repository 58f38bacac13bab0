"""A store of image payloads that grows over runs.

``<path>/data/run=<name>`` holds what one run has added, written once and never changed;
``<path>/snapshots/<number>`` lists the runs that make up the store. A run first writes its rows, then
puts the next snapshot in place by one rename that fails if somebody else was faster; then it
looks up again what is new. So readers see all of a run or nothing, a failed run leaves no row
behind that is read, and a payload is stored once whoever asks for it.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import images
from leafmill.operators.dedupe import keep_first
from leafmill.operators.media import image_refs, usable_assets

SCHEMA = "url string, file_key string, content_type string, size long, bytes binary"


class AssetStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._files = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    # --- snapshots -----------------------------------------------------------------

    def _names(self, folder: str) -> list[str]:
        place = self._at(folder)
        if not self._files.exists(place):
            return []
        return sorted(f.getPath().getName() for f in self._files.listStatus(place))

    def snapshot(self) -> tuple[int, list[str]]:
        """Number of the present snapshot, 0 for none, and its runs."""
        found = [n for n in self._names("snapshots") if n.isdigit()]
        if not found:
            return 0, []
        stream = self._files.open(self._at(f"snapshots/{found[-1]}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return int(found[-1]), json.loads(text)["runs"]

    def _commit(self, number: int, runs: list[str]) -> bool:
        """Put a snapshot in place; False if its number is taken."""
        draft = self._at(f"snapshots/.draft-{uuid.uuid4().hex}")
        stream = self._files.create(draft)
        stream.write(bytearray(json.dumps({"runs": runs}).encode()))
        stream.close()
        rename = getattr(self._hadoop, "Options$Rename")
        none = self.spark.sparkContext._gateway.new_array(rename, 1)
        none[0] = rename.NONE
        context = self._hadoop.FileContext.getFileContext(self._at("").toUri(), self._conf)
        qualified = self._files.makeQualified
        try:
            context.rename(qualified(draft), qualified(self._at(f"snapshots/{number:012d}")), none)
        except Py4JJavaError as error:
            self._files.delete(draft, False)
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    # --- rows ----------------------------------------------------------------------

    def table(self) -> DataFrame:
        """(url, file_key, content_type, size, bytes) of the present snapshot."""
        return self._rows(self.snapshot()[1])

    def _rows(self, runs: list[str]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], SCHEMA)
        # the base path keeps the run out of the columns that a file must have
        held = self.spark.read.schema(SCHEMA + ", run string").parquet(f"{self.path}/data")
        return held.filter(F.col("run").isin(runs)).drop("run")

    def add(self, docs: DataFrame, assets: DataFrame, key: str = "page_id") -> int:
        """Store the usable payloads that ``docs`` refer to and the store has not; their number.

        ``docs``: key, markdown. ``assets``: url, content_type, bytes; of several rows of one
        url the first by type and checksum counts. Nothing is written if nothing is new.
        """
        wanted = image_refs(docs, key).select("url").distinct()
        while True:
            number, runs = self.snapshot()
            missing = wanted.join(self._rows(runs).select("url"), "url", "left_anti")
            payloads = keep_first(usable_assets(assets), ["url"], ["content_type", F.md5("bytes")])
            rows = payloads.join(missing, "url", "left_semi").select(
                "url",
                images.image_file_key(F.col("url")).alias("file_key"),
                "content_type",
                F.octet_length("bytes").cast("long").alias("size"),
                "bytes",
            )
            run = uuid.uuid4().hex
            seen = Observation(f"added-{run}")
            place = f"data/run={run}"
            try:
                rows.observe(seen, F.count("*").alias("n")).write.parquet(f"{self.path}/{place}")
            except Exception:
                self._files.delete(self._at(place), True)
                raise
            added = seen.get["n"]
            if added and self._commit(number + 1, [*runs, run]):
                return added
            self._files.delete(self._at(place), True)
            if not added:
                return 0

    def manifest(self, docs: DataFrame, key: str = "page_id") -> DataFrame:
        """(url, file_key, size) of the stored images that ``docs`` refer to."""
        wanted = image_refs(docs, key).select("url").distinct()
        return self.table().select("url", "file_key", "size").join(wanted, "url", "left_semi")

    def remove_unlisted(self) -> int:
        """Delete the rows of runs that no snapshot lists; not while another run is adding."""
        runs = {f"run={r}" for r in self.snapshot()[1]}
        lost = [n for n in self._names("data") if n not in runs]
        for name in lost:
            self._files.delete(self._at(f"data/{name}"), True)
        return len(lost)
