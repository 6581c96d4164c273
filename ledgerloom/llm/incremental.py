"""New batches held against all history through a table of content-defined chunks.

A payment's name form is cut where a rolling hash of the last letters says so,
and between words; the cuts depend on nearby letters only, so a typo, a cut-off
end or another order of words leaves most chunks as they are. The chunk table
(payment, slot, chunk hashes, bytes) is kept in files, and the chunks of the
accepted batch are appended. In a slot of many payments a new batch is joined
with it, shared bytes are summed per pair, and pairs with enough coverage are
confirmed by the names themselves. A slip can leave a short name no chunk in
common with its like, so the names of such a slot that are alike by exact keys
are confirmed as well; and where a slot has few payments, all its pairs are held
against each other by name, to which chunks in common would add nothing.
"""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import records
from ledgerloom.llm.graph import components
from ledgerloom.runtime import Scratch, spread, stored, written

WINDOW, DIVISOR, MIN_COVERAGE = 2, 2, 0.2


def chunks_of(form: str) -> list[str]:
    """Chunks of a name form: cut between words and after letters whose rolling hash is a multiple of DIVISOR."""
    out = []
    for word in form.split(" "):
        start, rolling = 0, 0
        for i, ch in enumerate(word):
            rolling = rolling * 31 + ord(ch)
            if i >= WINDOW:
                rolling -= ord(word[i - WINDOW]) * 31**WINDOW
            if i - start + 1 >= WINDOW and (rolling * 2654435761 >> 13) % DIVISOR == 0:
                out.append(word[start : i + 1])
                start = i + 1
        if start < len(word):
            out.append(word[start:])
    return out


def _chunk_rows(batches):
    known: dict[str, dict[int, int]] = {}
    for pdf in batches:
        if len(known) > 1 << 16:
            known.clear()
        words, sizes = [], []
        for form in pdf["form"]:
            cut: dict[int, int] = {}
            for word in form.split(" "):
                if word not in known:
                    hashes = {c: xxhash.xxh64_intdigest(c) for c in chunks_of(word)}
                    known[word] = {h - (h >> 63 << 64): len(c) for c, h in hashes.items()}
                cut |= known[word]
            words.append(list(cut))
            sizes.append(list(cut.values()))
        yield pd.DataFrame({"pay": pdf["pay"], "slot": pdf["slot"], "words": words, "bytes": sizes})


def chunk_rows(pays: DataFrame, *slot: str) -> DataFrame:
    """(pay, slot, words, bytes): one row per payment, with the hashes and lengths of its chunks; the columns ``slot`` are the parts of its slot."""
    rows = pays.select("pay", F.xxhash64(*slot).alias("slot"), "form")
    return rows.mapInPandas(_chunk_rows, "pay long, slot long, words array<long>, bytes array<int>")


def chunk_table(rows: DataFrame) -> DataFrame:
    """(chunk, pay, bytes, total): one row per payment and chunk of ``chunk_rows``.

    ``chunk`` is the hash of the chunk's text together with the payment's slot;
    ``total`` are the bytes of all chunks of the payment's name.
    """
    total = F.aggregate("bytes", F.lit(0), lambda x, y: x + y).alias("total")
    each = rows.select("pay", "slot", total, F.explode(F.arrays_zip("words", "bytes")).alias("c"))
    return each.select(F.xxhash64("slot", "c.words").alias("chunk"), "pay", F.col("c.bytes").alias("bytes"), "total")


def rare(table: DataFrame, asked: DataFrame, bound: int = records.BOUND) -> DataFrame:
    """The asked chunks that at most ``bound`` payments of the table have.

    A chunk that more payments of a slot have tells nothing, and would meet
    itself in their square. They stand in a slot beyond the bound, where
    ``records.slot_pairs`` compares names by exact keys.
    """
    held = table.join(asked.select("chunk").distinct(), "chunk", "left_semi").groupBy("chunk").agg(F.count("*").alias("n"))
    return asked.join(held.where(F.col("n") > bound).select("chunk"), "chunk", "left_anti")


def covered_pairs(table: DataFrame, asked: DataFrame, least: float = MIN_COVERAGE) -> DataFrame:
    """Pairs (a < b) of payments whose shared chunks cover ``least`` of the shorter name."""
    met = asked.alias("q").join(table.alias("t"), "chunk").where("q.pay <> t.pay")
    met = met.select(F.least("q.pay", "t.pay").alias("a"), F.greatest("q.pay", "t.pay").alias("b"), "chunk", "q.bytes", F.least("q.total", "t.total").alias("total"))
    shared = met.groupBy("a", "b").agg(F.sum("bytes").alias("bytes"), F.min("total").alias("total"), F.count_distinct("chunk").alias("k"), F.count("*").alias("met"))
    return shared.where(F.col("bytes") * F.col("k") / F.col("met") >= least * F.col("total")).select("a", "b")


def hot_links(new: DataFrame, every: DataFrame, chunks: DataFrame, slots: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Links between payments ``new`` and ``every`` within the large slots ``slots``, with the chunks of all; None if no new payment is near one."""
    asked = new.withColumn("at", F.explode(F.array(F.col("day") - 1, F.col("day"), F.col("day") + 1)))
    hot = scratch.written(asked.join(slots, ["dir", "cents", "at"]), "hot")
    alike = records.hot_pairs(hot, every)
    if alike is None:
        return None
    asked = scratch.written(chunk_table(chunk_rows(spread(hot), "dir", "cents", "at")), "asked")
    table = chunk_table(chunks.join(slots.select(F.xxhash64("dir", "cents", "at").alias("slot")), "slot", "left_semi"))
    return records.confirmed(covered_pairs(table, rare(table, asked)).unionByName(alike).distinct(), every)


def payment_links(new: DataFrame, near: DataFrame | None, chunks: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b, as nodes) of same payments: one of ``new``, the other of ``new`` or ``near`` (None: there are none), with the chunks of all."""
    every = new if near is None else near.unionByName(new)
    slots = scratch.written(records.crowded(every), "slots")
    if slots.isEmpty():
        return records.slot_links(new, near, None)
    more = hot_links(new, every, chunks, slots, scratch)
    few = records.slot_links(new, near, slots)
    return few if more is None else few.unionByName(more)


class History:
    """Accepted records in a folder that all executors share; batches are appended, never rewritten.

    Every call of ``accept`` adds one increment to the tables *pays* (distinct
    payments), *chunks* (payment to chunks), *refs* (reference to node), *rows*
    (id, batch, node) and *labels* (node to the root of its record, the last
    increment counts), and then one row to *commits*. Only increments that stand
    there are read: what a failed call left behind is overwritten by the next
    one. Batches that were accepted before are ignored, so a call can be
    repeated.

    A batch is joined with the payments of its slots and the references; only classes of
    records that it hits are contracted, and only their labels written again.
    So a row that ties two records of earlier batches together ties them for
    ``repeats`` too, as if all rows had been seen at once.
    """

    TABLES = {
        "pays": "node binary, pay long, dir string, cents long, day int, form string", "chunks": "pay long, slot long, words array<long>, bytes array<int>",
        "refs": "ref binary, node binary", "rows": "id string, batch int, node binary", "labels": "node binary, root binary, n int",
    }

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def commits(self) -> tuple[list[int], list[int]]:
        """(increments, batches) accepted so far: one small row per call of ``accept``."""
        try:
            rows = self.spark.read.schema("n int, batches array<int>").parquet(f"{self.folder}/commits/*").collect()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = []
        return sorted(r.n for r in rows), sorted({b for r in rows for b in r.batches})

    def _read(self, name: str, done: list[int]) -> DataFrame:
        """One table, of the increments ``done``."""
        paths = [f"{self.folder}/{name}/n{n}" for n in done]
        if paths:
            return self.spark.read.schema(self.TABLES[name]).parquet(*paths)
        return self.spark.range(0).select(*[F.lit(None).cast(kind).alias(c) for c, kind in (x.split(" ") for x in self.TABLES[name].split(", "))]).limit(0)

    def current(self, done: list[int], nodes: DataFrame | None = None) -> DataFrame:
        """(node, root) by the last of the increments ``done`` that labelled the node; of the ``nodes`` given, or all."""
        labels = self._read("labels", done)
        labels = labels if nodes is None else labels.join(nodes, "node", "left_semi")
        return labels.groupBy("node").agg(F.max_by("root", "n").alias("root"))

    def _resolve(self, batch: DataFrame, scratch: Scratch, n: int, put, done: list[int]) -> dict[str, DataFrame]:
        rows = scratch.written(records.keyed(batch, F.col("ingest_batch").alias("batch")), "rows")
        pays, near = records.payments(rows), None
        if done:
            days = rows.where("paid").agg(F.min("day") - 1, F.max("day") + 1).first()
            near = self._read("pays", done).where(F.col("day").between(*days) if days[0] is not None else F.lit(False))
            pays = pays.join(near.select("node"), "node", "left_anti")
        new = put(pays, "pays")
        chunks = put(chunk_rows(new, "dir", "cents", "day"), "chunks")
        links = payment_links(new, near, self._read("chunks", done).unionByName(chunks), scratch)
        held = rows.where("ref is not null").select("ref", "node").distinct()
        known = self._read("refs", done).join(held.select("ref").distinct(), "ref", "left_semi")
        links = scratch.written(links.unionByName(records.reference_links(held.unionByName(known))), "found")
        firsts = held.groupBy("ref").agg(F.min("node").alias("node")).join(known.select("ref").distinct(), "ref", "left_anti")
        out = {"refs": firsts, "rows": rows.select("id", "batch", "node")}
        if not done:
            return out | {"labels": put(components(links).withColumn("n", F.lit(n)), "labels").drop("n")}
        ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        was = scratch.written(self.current(done, ends), "was")
        roots = components(links.unionByName(was.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        moved = roots.withColumnRenamed("root", "to").join(was.select(F.col("root").alias("node")).distinct(), "node", "left_semi")
        members = self._read("labels", done).select("node", F.col("root").alias("of")).join(moved.select(F.col("node").alias("of")), "of", "left_semi").select("node").distinct()
        inside = self.current(done, members).join(moved.select(F.col("node").alias("root"), "to"), "root").select("node", F.col("to").alias("root"))
        labels = put(roots.unionByName(inside).distinct().withColumn("n", F.lit(n)), "labels")
        return out | {"labels": labels.drop("n")}

    def _fresh(self, batch: DataFrame, done: list[int]) -> DataFrame:
        return batch.where(F.col("ingest_batch").isNull() | ~F.col("ingest_batch").isin(done)) if done else batch

    def check(self, batch: DataFrame) -> DataFrame:
        """(id_a, id_b) for the batch's rows whose record was accepted before, directly or through other rows of either side.

        Nothing is appended. id_a is the least id of that record, the batch's own rows included.
        """
        done, batches = self.commits()
        with Scratch(self.spark, "check") as scratch:
            new = self._resolve(self._fresh(batch, batches), scratch, 0, scratch.written, done)
            label = new["labels"]
            of = lambda rows: rows.join(label, "node", "left").withColumn("cls", F.coalesce("root", "node"))
            mine = of(new["rows"]).where("cls is not null")
            hit = mine.select("cls").distinct()
            old = of(self._read("rows", done)).join(hit, "cls", "left_semi").groupBy("cls").agg(F.min("id").alias("old_id"))
            least = mine.groupBy("cls").agg(F.min("id").alias("own_id")).join(old, "cls").select("cls", F.least("own_id", "old_id").alias("id_a"))
            return written(mine.join(least, "cls").select("id_a", F.col("id").alias("id_b")), "checked")

    def accept(self, batch: DataFrame) -> None:
        """Append the rows of a batch, or of several at once; nothing happens without rows that are new."""
        done, batches = self.commits()
        batch = self._fresh(batch, batches)
        held = [r[0] for r in batch.select("ingest_batch").distinct().collect()]
        if not held:
            return
        batches = [b for b in held if b is not None]
        n = max(done, default=-1) + 1
        put = lambda df, name: stored(df, f"{self.folder}/{name}/n{n}")
        with Scratch(self.spark, "accept") as scratch:
            new = self._resolve(batch, scratch, n, put, done)
            put(new["refs"], "refs")
            put(new["rows"], "rows")
        stored(self.spark.range(1, numPartitions=1).select(F.lit(n).alias("n"), F.array(*map(F.lit, batches)).cast("array<int>").alias("batches")), f"{self.folder}/commits/n{n}")

    def repeats(self) -> DataFrame:
        """(id_a, id_b) for every accepted row whose record an earlier batch has; id_a is the least id of the record.

        Rows with a null batch neither count as earlier nor are reported.
        """
        done = self.commits()[0]
        classed = self._read("rows", done).where("node is not null").join(self.current(done), "node", "left").withColumn("cls", F.coalesce("root", "node"))
        firsts = classed.groupBy("cls").agg(F.min("id").alias("id_a"), F.min("batch").alias("first_batch"), F.max("batch").alias("last_batch"))
        firsts = firsts.where("last_batch > first_batch").drop("last_batch")
        return classed.join(firsts, "cls").where("batch > first_batch").select("id_a", F.col("id").alias("id_b"))


def replay(df: DataFrame, folder: str, at_once: int = 40) -> History:
    """A history of all batches of a table, accepted in their order, ``at_once`` batch numbers a call; rows without a batch come first.

    The rows found don't depend on ``at_once``.
    """
    history = History(df.sparkSession, folder)
    held = [r[0] for r in df.select("ingest_batch").distinct().collect()]
    numbers = sorted(b for b in held if b is not None)
    for i in range(0, max(len(numbers), 1), at_once):
        some = numbers[i : i + at_once]
        inside = F.col("ingest_batch").between(some[0], some[-1]) if some else F.lit(False)
        history.accept(df.where(inside | F.col("ingest_batch").isNull()) if i == 0 else df.where(inside))
    return history
