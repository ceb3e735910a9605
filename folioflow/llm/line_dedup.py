"""Line dedup by a suffix array over line ids, in DataFrame operations only.

The corpus is a sequence of line ids; blank lines do not count. Distributed prefix doubling ranks
its suffixes: a suffix's rank by 2h lines is the place of (rank by h lines, rank by h lines of the
suffix h lines on) in one distributed sort of the *distinct* pairs, so a line of a third of the
corpus is one row there. Suffixes that share their first h lines with no other leave for good; no
later round carries them.

Suffixes with the same rank are an interval of the suffix array whose longest common prefix is at
least that many lines; two overlapping ranks give the intervals of any length between. From each
suffix the shortest run of at least `min_words` words is looked up; in its interval the first
suffix, by (doc_id, place), is kept and the later ones are cut. These runs cover a maximal repeated
run but for the lines after the last start that still has enough words before it: fewer than
`min_words` words, so fewer lines. From the last of each chain of cut starts the run therefore goes
on to the longest one that has an earlier copy, by appending blocks of 32, 16, ... 1 lines of the
stored ranks. Together they are the maximal repeated runs, so doubling can stop at `min_words` lines.

Deleted lines are cut with their line break; blank lines stay. Null texts stay null and empty ones
empty. Rows with a null doc_id stay as they are and are no copy of anything. Rows with equal doc_id
and text are one document: they are cut alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.llm.shared import Scratch

MIN_WORDS = 50



def lines_of(documents: DataFrame) -> DataFrame:
    """(doc_id, row, seq, raw, words, h1, h2) of every line that is not blank."""
    parts = F.transform(
        F.split(F.col("text"), "\n"),
        lambda line, raw: F.struct(
            raw.alias("raw"), F.regexp_count(line, F.lit(r"\S+")).alias("words"),
            F.xxhash64(line).alias("h1"), F.hash(line).alias("h2"),
        ),
    )
    held = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        "doc_id", F.xxhash64("doc_id", "text").alias("row"),
        F.posexplode(F.filter(parts, lambda p: p["words"] > 0)).alias("seq", "line"),
    )
    return held.select("doc_id", "row", "seq", "line.raw", "line.words", "line.h1", "line.h2")


def _ranked(keys: DataFrame, by: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Distinct keys that occur more than once, with numbers in their sort order.

    Written before use: a number must not change when a task is run again.
    """
    repeated = keys.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select(*by)
    ordered = repeated.orderBy(*by).withColumn("rank", F.monotonically_increasing_id())
    return scratch.save(ordered, name)


def suffix_levels(lines: DataFrame, scratch: Scratch, depth: int) -> list[DataFrame]:
    """Tables (row, seq, rank) of suffixes that share their first 1, 2, 4, ... lines with another.

    Ranks of a table order its suffixes by those lines. Ends when none is left, or at `depth`.
    """
    names = _ranked(lines, ["h1", "h2"], scratch, "names-0")
    first = lines.join(names, ["h1", "h2"]).select("doc_id", "row", "seq", "raw", "words", "rank")
    levels = [scratch.save(first, "level-0")]
    scratch.drop("names-0")
    while 2 ** len(levels) <= depth and not levels[-1].isEmpty():
        step = 2 ** (len(levels) - 1)
        here = levels[-1].select("row", "seq", F.col("rank").alias("r1"))
        ahead = levels[-1].select("row", (F.col("seq") - step).alias("seq"), F.col("rank").alias("r2"))
        pairs = scratch.save(here.join(ahead, ["row", "seq"]), "pairs")
        names = _ranked(pairs, ["r1", "r2"], scratch, f"names-{len(levels)}")
        following = pairs.join(names, ["r1", "r2"]).select("row", "seq", "rank")
        levels.append(scratch.save(following, f"level-{len(levels)}"))
        scratch.drop(f"names-{len(levels) - 1}")
    return levels


def _shortest_runs(first: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, row, seq, n, raws): from each suffix, the fewest repeated lines with enough words."""
    ahead = Window.partitionBy("row").orderBy("seq").rowsBetween(0, min_words - 1)
    taken = F.aggregate(
        F.col("ahead"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("words")),
        lambda a, x: F.when(a["words"] >= min_words, a).otherwise(
            F.struct((a["n"] + 1).alias("n"), (a["words"] + x["words"]).alias("words"))
        ),
    )
    runs = first.dropDuplicates(["row", "seq"]).withColumn(
        "ahead", F.collect_list(F.struct("seq", "words", "raw")).over(ahead)
    )
    runs = runs.select("doc_id", "row", "seq", "ahead", taken.alias("taken")).where(
        F.col("taken.words") >= min_words
    )
    return runs.select(
        "doc_id", "row", "seq", F.col("taken.n").alias("n"), F.slice("ahead", 1, F.col("taken.n")).alias("run")
    ).where(
        F.element_at("run", -1)["seq"] == F.col("seq") + F.col("n") - 1
    ).select("doc_id", "row", "seq", "n", F.col("run.raw").alias("raws"))


def later_runs(documents: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, row, seq, n, raws) of repeated runs that have an earlier copy; raws are lines to cut.

    Their union is that of all maximal runs of at least `min_words` words with an earlier copy.
    """
    # rows with equal doc_id and text are one: kept apart, doubling would pair their places at every level
    lines = scratch.save(lines_of(documents).dropDuplicates(["row", "seq"]), "lines")
    levels = suffix_levels(lines, scratch, depth=min_words)
    scratch.drop("lines")
    scratch.drop("pairs")
    runs = scratch.save(_shortest_runs(levels[0], min_words), "runs")
    found = []
    for place, level in enumerate(levels):
        step = 2**place
        mine = runs.where((F.col("n") >= step) & (F.col("n") < 2 * step))
        ranks = level.select("row", "seq", "rank").dropDuplicates(["row", "seq"])
        # two overlapping prefixes of 2^place lines cover the run: its interval of the suffix array
        head = ranks.select("row", "seq", F.col("rank").alias("r1"))
        tail = ranks.select("row", F.col("seq").alias("tail"), F.col("rank").alias("r2"))
        placed = (
            mine.withColumn("tail", F.col("seq") + F.col("n") - step).join(head, ["row", "seq"]).join(tail, ["row", "tail"])
        )
        placed = scratch.save(placed, f"placed-{place}")
        firsts = placed.groupBy("n", "r1", "r2").agg(
            F.min(F.struct("doc_id", "row", "seq")).alias("kept"), F.count("*").alias("copies")
        ).where("copies > 1")
        found.append(placed.join(firsts, ["n", "r1", "r2"]).select("doc_id", "row", "seq", "n", "raws", "kept"))
    copies = scratch.save(reduce(DataFrame.unionByName, found), "copies")
    later = copies.where(F.struct("doc_id", "row", "seq") > F.col("kept")).select("doc_id", "row", "seq", "n", "raws")
    return later.unionByName(_continued(copies, levels, scratch))


def _continued(copies: DataFrame, levels: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(doc_id, row, seq, n, raws): of every last run of a chain of cuts, each line that continues it.

    Copies of one run are named by their first (`kept`) and their length (n). Where several go on
    alike by a block, the later ones move to the longer run and the first stays; it is also listed
    there (not as its `own` place), so that later blocks are compared with it, too.
    """
    place = F.struct("doc_id", "row", "seq")
    following = F.lead("seq").over(Window.partitionBy("row").orderBy("seq"))
    ends = copies.where(place > F.col("kept")).withColumn("next", following)
    ends = scratch.save(
        ends.where("next IS NULL OR next > seq + 1").select("row", "seq", F.col("n").alias("shortest"), "kept"), "ends"
    )
    asked = ends.select("kept", F.col("shortest").alias("n")).distinct()
    members = copies.join(asked, ["kept", "n"], "left_semi").select(
        "kept", "n", "doc_id", "row", "seq", F.lit(True).alias("own")
    )
    for level in reversed(range(len(levels))):
        ranks = levels[level].select("row", F.col("seq").alias("at"), "rank").dropDuplicates(["row", "at"])
        ahead = members.withColumn("at", F.col("seq") + F.col("n")).join(ranks, ["row", "at"], "left").drop("at")
        ahead = scratch.save(ahead, f"ahead-{level}")
        firsts = ahead.where("rank IS NOT NULL").groupBy("kept", "n", "rank").agg(
            F.min(place).alias("first"), F.count("*").alias("copies")
        ).where("copies > 1").drop("copies")
        stay = F.struct("kept", "n", "own")
        move = F.struct(
            F.col("first").alias("kept"), (F.col("n") + 2**level).alias("n"),
            (F.col("own") & (place > F.col("first"))).alias("own"),
        )
        states = F.when(F.col("first").isNull(), F.array(stay)).otherwise(
            F.when(place == F.col("first"), F.array(stay, move)).otherwise(F.array(move))
        )
        met = ahead.join(firsts, ["kept", "n", "rank"], "left").select("doc_id", "row", "seq", F.explode(states).alias("state"))
        members = scratch.save(met.select("state.kept", "state.n", "doc_id", "row", "seq", "state.own"), f"members-{level}")
        scratch.drop(f"ahead-{level}")
    longer = members.where("own").drop("kept").join(ends.drop("kept"), ["row", "seq"]).where("n > shortest")
    lines = longer.select(
        "doc_id", "row", "seq", "n",
        F.explode(F.sequence(F.col("seq") + F.col("shortest"), F.col("seq") + F.col("n") - 1)).alias("at"),
    )
    raws = levels[0].select("row", F.col("seq").alias("at"), "raw").dropDuplicates(["row", "at"])
    return lines.join(raws, ["row", "at"]).select("doc_id", "row", "seq", "n", F.array("raw").alias("raws"))


def deduplicated_documents(
    documents: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS
) -> DataFrame:
    """All rows and columns, text without later copies of repeated line runs; and n_lines, n_deleted.

    n_lines counts the lines of the given text, n_deleted those cut from it; given columns of these
    names are replaced.
    """
    cuts = scratch.save(
        later_runs(documents, scratch, min_words)
        .groupBy("doc_id", "row")
        .agg(F.array_distinct(F.flatten(F.collect_set("raws"))).alias("cut")),
        "cuts",
    ).select(F.col("row").alias("__row"), F.col("cut").alias("__cut"))
    keyed = documents.withColumn(
        "__row", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    )
    parts = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - F.lit(1)), F.col("__cut"))
    shorter = F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")
    # a merge at every size: texts move once, and the plan does not turn with the number of cuts
    joined = keyed.join(cuts.hint("merge"), "__row", "left").drop("__row")
    return joined.select(
        *[c for c in documents.columns if c not in ("text", "n_lines", "n_deleted")],
        F.when(F.col("__cut").isNull(), F.col("text")).otherwise(shorter).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).alias("n_lines"),
        F.coalesce(F.size("__cut"), F.lit(0)).alias("n_deleted"),
    )


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its deduplicated text."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicated_documents(documents, Scratch(spark))


#: Every two places with equal lines; neighbours on one diagonal are a maximal run.
OP1_SQL = f"""
WITH l AS (
  SELECT doc_id, generate_subscripts(parts, 1) - 1 AS raw, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE doc_id IS NOT NULL)
), n AS (
  SELECT doc_id, raw, line, len(regexp_extract_all(line, '\\S+')) AS words FROM l
), s AS (
  SELECT doc_id, raw, line, words, row_number() OVER (PARTITION BY doc_id ORDER BY raw) AS seq FROM n WHERE words > 0
), pairs AS (
  SELECT x.doc_id, y.doc_id AS earlier, x.seq, x.seq - y.seq AS shift, x.raw, x.words FROM s x JOIN s y USING (line)
  WHERE x.doc_id > y.doc_id OR (x.doc_id = y.doc_id AND x.seq > y.seq)
), runs AS (
  SELECT *, seq - row_number() OVER (PARTITION BY doc_id, earlier, shift ORDER BY seq) AS run FROM pairs
), summed AS (
  SELECT doc_id, raw, sum(words) OVER (PARTITION BY doc_id, earlier, shift, run) AS words FROM runs
), cuts AS (
  SELECT DISTINCT doc_id, raw FROM summed WHERE words >= {MIN_WORDS}
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.raw) AS text
  FROM l LEFT JOIN cuts c ON c.doc_id = l.doc_id AND c.raw = l.raw WHERE c.raw IS NULL GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS INTEGER) AS n_lines,
  CAST((SELECT count(*) FROM cuts c WHERE c.doc_id = d.doc_id) AS INTEGER) AS n_deleted
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
