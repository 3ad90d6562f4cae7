"""Dropping lines that many documents share, with levelled sorted runs of line hashes; DataFrame functions only.

A line's key is the line without white space at both ends and with A-Z in lower case. Keys of LENGTH code points or more
go by two 64-bit hashes (128 bits). Documents come in batches by falling id. A batch's keys, counted, are merge-anti-
joined with the runs: keys that no run holds are new, and the batch's largest id that has one is the document that keeps
it, as all later batches have lesser ids; known keys add their count only. The batch's entries become a run of level 0,
a table bucketed and sorted by key, so neither the joins nor compaction deal a run out again. FAN runs of a level are
merged into one of the next. After the last batch all runs are merged, and keys that COPIES documents or more have lose
their lines in every document but the one that keeps them.

Places of the lines are found with the hashes and travel with them, so texts are dealt out once, by document, and cut
along sorted places in one pass. Keys with a HEAVY-th part of all lines, of which there are at most HEAVY, are broadcast;
no other key is large.

Defined results: a null or empty text is one empty line; rows are documents of their own, also if their ids or texts are
equal, and rows with the largest id that has a key all keep it; a null id is less than any other; a key that repeats
inside a document counts once and all its lines go or stay; kept lines are as they were, other white space included; a
text that loses all lines is empty; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.base import lower_ascii, packed
from lociframe.session import ensure_checkpoint_dir, remove_folder

LENGTH, COPIES = 40, 5
BATCHES = 4
FAN = 2
HEAVY = 1000
WHITE = " \t\n\x0b\x0c\r"
SEED = 1201  # of the second hash

KEY = ["h1", "h2"]


def _let(value: Column, fn) -> Column:
    """`fn` of a value that is computed once."""
    return F.get(F.transform(F.array(value), fn), 0)


def line_key(line: Column) -> Column:
    plain = F.octet_length(line) == F.length(line)  # ASCII only: the fast way gives the same
    return F.btrim(F.when(plain, F.lower(line)).otherwise(lower_ascii(line)), F.lit(WHITE))


def keyed_places(text: Column) -> Column:
    """Distinct long keys of a text: h1, h2 and the places of their lines, from 0."""
    keys = F.transform(F.split(text, "\n"), line_key)
    every = F.transform(keys, lambda k, i: F.struct((F.length(k) >= LENGTH).alias("long"), F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(SEED), k).alias("h2"), i.alias("i")))

    def grouped(s: Column) -> Column:
        other = lambda j: (F.get(s, j - 1)["h1"] != F.get(s, j - 2)["h1"]) | (F.get(s, j - 1)["h2"] != F.get(s, j - 2)["h2"])
        begins = F.filter(F.sequence(F.lit(1), F.size(s)), lambda j: (j == 1) | other(j))

        def runs(b: Column) -> Column:
            def run(at: Column, k: Column) -> Column:
                own = F.slice(s, at, F.coalesce(F.get(b, k + 1), F.size(s) + 1) - at)
                return F.struct(F.get(s, at - 1)["h1"].alias("h1"), F.get(s, at - 1)["h2"].alias("h2"), F.transform(own, lambda x: x["i"]).alias("places"))

            return F.transform(b, run)

        return F.when(F.size(s) > 0, _let(begins, runs))

    return _let(F.sort_array(F.filter(every, lambda e: e["long"])), grouped)


class LineRuns:
    """Levelled sorted runs of line keys: h1, h2, n (documents), top (the id that keeps the key)."""

    def __init__(self, spark: SparkSession, folder: str, fan: int = FAN):
        self.spark, self.folder, self.fan = spark, folder, fan
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, DataFrame]]] = []
        self.written = 0
        self.merged_away: list[str] = []

    def _store(self, entries: DataFrame, level: int) -> None:
        """Write a sorted run."""
        path, name = f"{self.folder}/run-{self.written}", f"line_run_{uuid.uuid4().hex}"
        self.written += 1
        laid = entries.repartition(self.buckets, *KEY)
        laid.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((path, self.spark.table(name)))
        self.spark.sql(f"DROP TABLE {name}")  # the name only: the files stay, and the frame knows their buckets

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for _, run in level]

    def add(self, keys: DataFrame) -> DataFrame:
        """Take in a batch (h1, h2, id: a row for each document that has the key) and return its keys that are new.

        Ids of the batch must be less than those of all batches before it. The returned frame can be read until the next
        batch comes: files that compaction has merged away are removed then.
        """
        while self.merged_away:
            remove_folder(self.spark, self.merged_away.pop())
        own = keys.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
        fresh, known = own, None
        for run in self.runs():
            seen = run.select(*KEY)
            again = own.join(seen, KEY, "left_semi")
            known = again if known is None else known.unionByName(again)
            fresh = fresh.join(seen, KEY, "left_anti")
        entries = fresh
        if known is not None:  # a key may be in several runs
            again = known.dropDuplicates(KEY).withColumn("top", F.lit(None).cast(keys.schema["id"].dataType))
            entries = fresh.unionByName(again)
        self._store(entries, 0)
        newest = self.levels[0][-1][1]
        self._compact()
        return newest.where(F.col("top").isNotNull())

    def _compact(self) -> None:
        """Merge full levels into the next."""
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fan:
                self._replace(level, level + 1)

    def _replace(self, level: int, target: int) -> None:
        old, self.levels[level] = self.levels[level], []
        self._store(_merged([run for _, run in old]), target)
        self.merged_away += [path for path, _ in old]

    def whole(self) -> DataFrame:
        """One entry per key, over all runs."""
        return _merged(self.runs())


def _merged(runs: list[DataFrame]) -> DataFrame:
    """Entries of sorted runs, merged by key: counts add up, and at most one run names the document that keeps a key."""
    whole = runs[0]
    for run in runs[1:]:
        other = run.select(*KEY, F.col("n").alias("m"), F.col("top").alias("also"))
        n = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
        whole = whole.join(other, KEY, "full").select(*KEY, n.alias("n"), F.coalesce("top", "also").alias("top"))
    return whole


def _kept(lines: Column, places: Column) -> Column:
    """Lines without those at the sorted `places`, joined."""

    def cut(ends: Column) -> Column:
        def piece(end: Column, k: Column) -> Column:
            start = F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1) + 1)
            return F.slice(lines, start + 1, end - start)

        return F.array_join(F.flatten(F.transform(ends, piece)), "\n")

    return _let(F.concat(places, F.array(F.size(lines))), cut)


def dedupe_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """`docs` as a struct `doc`, with n_lines, n_dropped and the text that is kept, `kept`. Ids are numbers."""
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}"
    text = F.coalesce(F.col(text_col), F.lit(""))
    shares = F.array(*[F.lit(k / batches) for k in range(1, batches)]).cast("array<double>")
    bounds = docs.select(F.percentile_approx(id_col, shares, F.lit(1000)).alias("b")).first().b if batches > 1 else None
    bounds = sorted(set(bounds or []), reverse=True)
    batch = sum((F.when(F.col("id") > b, 0).otherwise(1) for b in bounds), F.lit(0)).cast("int")  # null ids come last
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.explode(keyed_places(text)).alias("k"))
    rows.select("id", "th", "k.*", batch.alias("batch")).write.partitionBy("batch").parquet(f"{folder}/lines")
    kind = docs.schema[id_col].dataType.simpleString()
    lines = spark.read.schema(f"id {kind}, th long, h1 long, h2 long, places array<int>, batch int").parquet(f"{folder}/lines")
    runs = LineRuns(spark, folder)
    for k in range(len(bounds) + 1):
        runs.add(lines.where(F.col("batch") == k).select("id", *KEY))
    whole = f"{folder}/repeated"
    runs.whole().where(F.col("n") >= COPIES).write.parquet(whole)
    repeated = spark.read.schema(f"h1 long, h2 long, n long, top {kind}").parquet(whole)
    part = lines.count() // HEAVY + 1
    heavy = F.broadcast(repeated.where(F.col("n") >= part))  # fewer than HEAVY keys, as their counts add up to all lines
    light = repeated.where(F.col("n") < part)
    found = lines.join(heavy, KEY).unionByName(lines.join(heavy.select(*KEY), KEY, "left_anti").join(light, KEY))
    gone = found.where(~F.col("id").eqNullSafe(F.col("top")))
    places = F.array_sort(F.flatten(F.collect_set("places"))).alias("gone")  # equal rows have equal places
    gone = gone.groupBy(F.col("id").alias("gi"), F.col("th").alias("gh")).agg(places)
    all_ = packed(docs, F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))
    met = all_.join(gone, F.col("id").eqNullSafe(F.col("gi")) & (F.col("th") == F.col("gh")), "left")
    count = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(_let(F.split("text", "\n"), lambda all_lines: _kept(all_lines, F.col("gone"))))
    dropped = F.coalesce(F.size("gone"), F.lit(0))
    return met.select("doc", count.cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(dropped).cast("long").alias("n_dropped"), kept.alias("kept"))
