"""Incremental index of chunked documents: each update writes a layer of what changed, states name the layers that count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions.text import normal_lines, scan
from ledgerlark.operators.documents import hierarchical_chunks

_LANES = 4
_OF_DOCUMENT = ("version", "hash", "index_version", "n_chunks", "gone")


def next_version(version: Column) -> Column:
    """The number after a version of digits only; any other version gets .1 at its end."""
    return F.when(version.rlike(r"^[0-9]{1,37}\z"), (version.cast("decimal(37,0)") + 1).cast("string")).otherwise(F.concat(version, F.lit(".1")))


def index_version(key: Column, version: Column, chunk_ids: Column) -> Column:
    """The first 24 hex digits of the SHA-256 of a document's canonical JSON: its chunks' ids in order, its id, its version."""
    told = F.to_json(F.struct(chunk_ids.alias("chunks"), key.cast("string").alias("document_id"), version.alias("version")))
    return F.substring(F.sha2(told, 256), 1, 24)


def _lanes(version: str, indexed: str) -> list[Column]:
    """Four numbers of 60 bits that a document adds to the sums of the whole index; none without an index version."""
    digest = F.sha2(F.concat_ws(":", F.col("id").cast("string"), version, indexed), 256)
    number = lambda i: F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
    return [F.when(F.col(indexed).isNotNull(), number(i)).otherwise(F.lit(0).cast("decimal(20,0)")) for i in range(_LANES)]


class DocumentIndex:
    """Chunks of documents under a root folder that driver and executors share.

    An update is compared with the index by the hash of the normalised text. It writes one layer: p-N the changes, c-N the
    chunks of added and changed documents, d-N a row for each document that the layer replaces or removes. A state, of
    which the last is active, is a row with the numbers of its layers and the counts and sums of the whole index. Sums
    don't depend on the order of documents and are carried from state to state, so a small update reads headers only, no
    old chunks. Nothing is overwritten: old states stay readable, an update that dies leaves a layer that no state names,
    and the second of two writers at once fails. compact() folds all layers into one.

    Ids are unique and not null, else an update is refused. A null text is empty. A text that the scan objects to is
    blocked: it isn't indexed, and what the index held of that document stays. A document that comes back goes on from
    its last version. One task holds one document's chunks.
    """

    def __init__(self, spark: SparkSession, root: str, parent: int = 700, child: int = 220, overlap: int = 48) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._sizes = {"parent": parent, "child": child, "overlap": overlap}
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self, kinds: str, done: bool = False) -> list[int]:
        if not self._fs.exists(self._at(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.root))]
        return sorted({int(n[2:]) for n in names if n[0] in kinds and n[1] == "-" and (not done or self._fs.exists(self._at(f"{self.root}/{n}/_SUCCESS")))})

    def _read(self, kind: str, layers: list[int]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.root}/{kind}-{n}" for n in layers))

    # ---- states ----

    def states(self) -> list[int]:
        """Numbers of the published states, the active one last."""
        return self._numbers("s", done=True)

    def state(self, number: int | None = None) -> dict:
        """layers, documents, chunks and sums of a state, the active one unless told; an index without one is empty."""
        known = self.states()
        if number is not None and number not in known:
            raise ValueError(f"state {number} not found")
        if not known:
            return {"layers": [], "documents": 0, "chunks": 0, "sums": ["0"] * _LANES}
        return self._read("s", [number or known[-1]]).first().asDict()

    def _publish(self, state: dict) -> int:
        number = 1 + max(self._numbers("s"), default=0)
        row = [(state["layers"], state["documents"], state["chunks"], state["sums"])]
        self.spark.createDataFrame(row, "layers array<int>, documents long, chunks long, sums array<string>").coalesce(1).write.parquet(f"{self.root}/s-{number}")
        return number

    def fingerprint(self, number: int | None = None) -> str:
        """One hash of all documents, versions and chunks of a state, whatever their order or partitioning."""
        return self._hashed(self.state(number))

    def summary(self, number: int | None = None) -> DataFrame:
        """documents, chunks and fingerprint of a state as a row."""
        told = self._read("s", [number or self.states()[-1]])
        return told.select("documents", "chunks", F.sha2(F.concat_ws(":", F.col("documents").cast("string"), "sums"), 256).alias("fingerprint"))

    def _hashed(self, state: dict) -> str:
        told = F.sha2(F.lit(":".join([str(state["documents"]), *state["sums"]])), 256)
        return self.spark.range(1).select(told).first()[0]

    def verify(self, number: int | None = None) -> None:
        """Recounts a state from its chunks; anything but what it says is an error."""
        held = self.documents(number)
        own = self.chunks(number).groupBy("id").agg(self._chunk_ids())
        seen = held.join(own, "id", "left").withColumn("again", index_version(F.col("id"), F.col("version"), F.col("ids")))
        row = seen.agg(F.count("*"), F.coalesce(F.sum(F.size("ids")), F.lit(0)), *(F.coalesce(F.sum(x), F.lit(0)) for x in _lanes("version", "again"))).first()
        state = self.state(number)
        if (row[0], row[1], [str(x) for x in row[2:]]) != (state["documents"], state["chunks"], state["sums"]):
            raise ValueError("the index doesn't hold what its state says")

    # ---- reading ----

    def _documents(self, layers: list[int]) -> DataFrame:
        rows = self._read("d", layers)
        if len(layers) > 1:
            rows = rows.groupBy("id").agg(F.max_by(F.struct(*_OF_DOCUMENT, "layer"), "layer").alias("d")).select("id", "d.*")
        return rows

    def documents(self, number: int | None = None) -> DataFrame:
        """id, version, hash, index_version, n_chunks of the documents in a state."""
        return self._documents(self._layers(number)).where("not gone").drop("gone", "layer")

    def chunks(self, number: int | None = None) -> DataFrame:
        """The chunks of a state, as hierarchical_chunks gives them; a parent's text is with its first child only."""
        layers = self._layers(number)
        live = self._documents(layers).where("not gone").select("id", "layer")
        return self._read("c", layers).join(live, ["id", "layer"], "left_semi").drop("layer")

    def changes(self, number: int | None = None) -> DataFrame:
        """id, change and errors of the last update in a state; unchanged documents aren't listed."""
        return self._read("p", self._layers(number)[-1:]).select("id", "change", "errors")

    def _layers(self, number: int | None) -> list[int]:
        layers = self.state(number)["layers"]
        if not layers:
            raise ValueError("the index is empty")
        return layers

    # ---- writing ----

    @staticmethod
    def _texts(docs: DataFrame) -> DataFrame:
        version = F.col("version").cast("string") if "version" in docs.columns else F.lit(None).cast("string")
        return docs.select("id", version.alias("first"), normal_lines(F.coalesce("text", F.lit(""))).alias("text"))

    def plan(self, docs: DataFrame, whole: bool = True) -> DataFrame:
        """docs (id, text, perhaps version for new documents, else 1) -> id, change (added, changed, same, gone, blocked),
        version, hash, errors and was_*, what the index holds. Unless docs are the whole, missing documents stay."""
        told = self._texts(docs).select("id", "first", F.sha2("text", 256).alias("told"), scan(F.col("text")).alias("errors"))
        layers, bad = self.state()["layers"], F.size("errors") > 0
        if not layers:  # a first load needs no join
            none = F.lit(None).cast("string")
            return told.where("id is not null").select(
                "id", F.when(bad, "blocked").otherwise("added").alias("change"), F.when(~bad, F.coalesce("first", F.lit("1"))).alias("version"), F.col("told").alias("hash"), "errors",
                none.alias("was_version"), none.alias("was_index_version"), F.lit(None).cast("bigint").alias("was_n_chunks"),
            )
        there = self._documents(layers).drop("layer")
        both = told.join(there.select("id", *(F.col(c).alias(f"was_{c}") for c in _OF_DOCUMENT)), "id", "full")
        live = F.coalesce(~F.col("was_gone"), F.lit(False))
        missing = F.when(live & F.lit(whole), "gone")
        change = F.when(F.col("told").isNull(), missing).when(bad, "blocked").when(~live, "added").when(F.col("told") == F.col("was_hash"), "same").otherwise("changed")
        version = F.when(~F.col("change").isin("added", "changed"), F.col("was_version")).when(F.col("was_version").isNotNull(), next_version(F.col("was_version"))).otherwise(F.coalesce("first", F.lit("1")))
        return both.withColumn("change", change).where("change is not null").select(
            "id", "change", version.alias("version"), F.coalesce("told", "was_hash").alias("hash"), "errors",
            *(F.when(live, F.col(f"was_{c}")).alias(f"was_{c}") for c in ("version", "index_version", "n_chunks")),
        )

    def _pieces(self, docs: DataFrame, plan: DataFrame) -> DataFrame:
        if self.state()["layers"]:  # only what has changed is normalised again
            changed = plan.where(F.col("change").isin("added", "changed")).select("id", "version")
            new = self._texts(docs.select("id", "text").join(changed, "id")).withColumnRenamed("first", "version")
        else:  # what isn't blocked is new, so texts needn't move; a filter of rows would be pushed down and normalise texts again
            allowed = F.filter(F.array("text"), lambda t: F.size(scan(t)) == 0)
            new = self._texts(docs).select("id", F.coalesce("first", F.lit("1")).alias("version"), F.explode(allowed).alias("text"))
        return hierarchical_chunks(new.select("id", "version", "text"), **self._sizes, repeat_parents=False)

    @staticmethod
    def _chunk_ids() -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct("nth", "chunk_id"))), lambda c: c["chunk_id"]).alias("ids")

    def _replaced(self, plan: DataFrame, pieces: DataFrame) -> DataFrame:
        """The rows of d-N with what they replace."""
        own = pieces.groupBy("id").agg(self._chunk_ids())
        rows = plan.where(F.col("change").isin("added", "changed", "gone")).join(own, "id", "left")
        gone = F.col("change") == "gone"
        indexed = F.when(~gone, index_version(F.col("id"), F.col("version"), F.col("ids")))
        count = F.when(gone, 0).otherwise(F.size("ids")).cast("bigint")
        return rows.select("id", "change", "version", "hash", indexed.alias("index_version"), count.alias("n_chunks"), gone.alias("gone"), "was_version", "was_index_version", "was_n_chunks")

    def _after(self, state: dict, replaced: DataFrame) -> tuple[dict, dict]:
        """The state with the replaced rows in it, and the numbers of changes."""
        zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
        kinds = ("added", "changed", "gone")
        row = replaced.agg(
            *(F.count(F.when(F.col("change") == k, 1)) for k in kinds), zero(F.col("n_chunks") - F.coalesce("was_n_chunks", F.lit(0))),
            *(zero(new - old) for new, old in zip(_lanes("version", "index_version"), _lanes("was_version", "was_index_version"), strict=True)),
        ).first()
        counts = dict(zip(kinds, row[:3], strict=True))
        sums = [str(int(a) + int(b)) for a, b in zip(state["sums"], row[4:], strict=True)]
        return state | {"documents": state["documents"] + counts["added"] - counts["gone"], "chunks": state["chunks"] + row[3], "sums": sums}, counts

    def update(self, docs: DataFrame, dry_run: bool = False, whole: bool = True) -> dict:
        """Brings the index to docs and tells state, numbers of added, changed and gone documents, documents, chunks and
        fingerprint. A dry run tells the same but for the state, which is null, and writes nothing. Without a change no
        state is published; blocked documents alone are no change."""
        if docs.groupBy("id").count().where("id is null or count > 1").limit(1).count():
            raise ValueError("ids must be unique and not null")
        before, plan = self.state(), self.plan(docs, whole)
        if dry_run:
            after, counts = self._after(before, self._replaced(plan, self._pieces(docs, plan)))
            number = None
        else:
            layer = 1 + max(self._numbers("pcd"), default=0)
            plan.where("change <> 'same'").write.parquet(f"{self.root}/p-{layer}")
            plan, mark = self._read("p", [layer]), F.lit(layer).alias("layer")
            self._pieces(docs, plan).select("*", mark).write.parquet(f"{self.root}/c-{layer}")
            self._replaced(plan, self._read("c", [layer])).select("*", mark).write.parquet(f"{self.root}/d-{layer}")
            after, counts = self._after(before, self._read("d", [layer]))
            number = self._publish(after | {"layers": [*before["layers"], layer]}) if any(counts.values()) else (self.states() or [None])[-1]
        return {"state": number, **counts, "documents": after["documents"], "chunks": after["chunks"], "fingerprint": self._hashed(after)}

    def rollback(self, number: int | None = None) -> int:
        """Publishes a state again, the one before the active one unless told; the layers since stay, unnamed."""
        if number is None:
            if len(self.states()) < 2:
                raise ValueError("no state to go back to")
            number = self.states()[-2]
        return self._publish(self.state(number))

    def compact(self) -> int:
        """Folds the layers of the active state into one; what it holds and its fingerprint stay the same."""
        state, layers = self.state(), self._layers(None)
        layer = 1 + max(self._numbers("pcd"), default=0)
        mark = F.lit(layer).alias("layer")
        self._read("p", layers[-1:]).write.parquet(f"{self.root}/p-{layer}")
        self.chunks().select("*", mark).write.parquet(f"{self.root}/c-{layer}")
        self._documents(layers).drop("layer").select("*", mark).write.parquet(f"{self.root}/d-{layer}")
        return self._publish(state | {"layers": [layer]})
