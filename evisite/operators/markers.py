"""Marked positions: explode, windows, rejects and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisite.functions.headers import clean_sequence, flanks
from evisite.operators.pairs import first_of


def explode_markers(df: DataFrame, seq: str = "seq", marker: str = "*", before: bool = False, context: bool = False) -> DataFrame:
    """One row per marker: ``poi`` letters stand before it (one less with ``before``), ``plain`` is the clean sequence.

    ``context`` adds ``left_, right_``, the letters around the place. They are cut before the rows are made, so that a text is copied to
    its markers only where ``plain`` or ``seq`` is asked for.
    """
    clean = clean_sequence(F.col(seq))
    at = F.filter(F.transform(F.split(clean, ""), lambda c, i: F.when(c == marker, i)), lambda i: i.isNotNull())  # letters and markers before each marker
    rows = df.withColumn("plain", F.replace(clean, F.lit(marker), F.lit(""))).withColumn("ends_", F.transform(at, lambda i, k: i - k - int(before)))

    def placed(i: Column) -> Column:
        cut = lambda start, n: F.array_join(F.slice("letters_", start + 1, n), "")  # noqa: E731; by the list, since each cut of the text would walk to its place
        start = F.greatest(i - 6, F.lit(0))
        left, right = F.lpad(cut(start, F.greatest(i - start, F.lit(0))), 6, "-"), F.rpad(cut(F.greatest(i, F.lit(0)), F.lit(6)), 6, "-")
        return F.struct(i.alias("poi"), *([left.alias("left_"), right.alias("right_")] if context else []))

    rows = rows.withColumn("letters_", F.split("plain", "")) if context else rows
    rows = rows.withColumn("ends_", F.transform("ends_", placed))
    rows = rows.select("*", F.posexplode_outer("ends_").alias("marker_no", "end_")).filter("marker_no is not null")  # a plain explode makes the list again to test its size
    return rows.select("*", "end_.*").drop("ends_", "end_", "letters_")


def header_locator(header: Column) -> Column:
    """The first position of ``POI:a-b`` in a header, or null."""
    return F.regexp_extract(header, r"(?i)POI:\s*(\d+)-\d+", 1).try_cast("int")


def normalise(sequences: DataFrame, acc: Column, order_by: str, before: bool = False) -> tuple[DataFrame, DataFrame]:
    """Sites and rejects of marked sequences (``header, seq``).

    A header locator replaces markers. Sites outside the sequence and sequences without any site are rejects; of
    repeated (accession, position) the first in order stays. Its letters around the site are cut before that choice, which so moves
    texts only where ``plain`` or ``seq`` is asked for.
    """
    base = sequences.withColumn("acc", acc).withColumn("locator", header_locator(F.col("header")))
    sized = base.withColumn("length_", F.length(F.replace(clean_sequence(F.col("seq")), F.lit("*"), F.lit(""))))
    marked = explode_markers(sized.filter("locator is null"), before=before, context=True).drop("marker_no")
    located = sized.filter("locator is not null").withColumn("plain", F.regexp_replace(clean_sequence(F.col("seq")), r"\*", "")).withColumn("poi", F.col("locator"))
    left, right = flanks(F.col("plain"), F.col("poi"))
    sites = marked.unionByName(located.withColumns({"left_": left, "right_": right}))
    good = (F.col("poi") >= 1) & (F.col("poi") <= F.col("length_"))
    none = base.filter("locator is null").filter(~F.col("seq").contains("*")).select("header", "acc", F.lit("no marker").alias("reason"))
    bad = sites.filter(~good).select("header", "acc", F.lit("position outside the sequence").alias("reason"))
    kept = first_of(sites.filter(good), ["acc", "poi"], [F.col(order_by)])
    kept = kept.withColumn("entry_id", F.concat("acc", F.lit("_Pos"), F.col("poi").cast("string"))).withColumn("poiseq", F.concat("left_", F.lit("/"), "right_"))
    return kept.drop("locator", "length_", "left_", "right_"), none.unionByName(bad)


def sample_positions(df: DataFrame, key: str, seq: str, letters: str, n: int = 5000, least: int = 25, seed: str = "1") -> DataFrame:
    """``n`` positions of the wanted letters from sequences of ``least`` letters or more, in a seeded hash order.

    A top-n of the whole table: each task keeps its own ``n`` first.
    """
    long = df.filter(F.length(seq) >= least)
    letter = F.posexplode(F.split(F.col(seq), "")).alias("at_", "aa")  # the text itself isn't copied to its letters
    spots = long.select(key, letter).filter(F.col("aa").isin(list(letters))).select(key, (F.col("at_") + 1).alias("poi"), "aa")
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), F.col("poi").cast("string")))
    return spots.withColumn("order_", order).orderBy("order_", key, "poi").limit(n).drop("order_")


def _uniform(key: Column, *parts) -> Column:
    """A number between 0 and 1 from the digest of a key and further parts."""
    digest = F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts], key.cast("string")))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / 2.0**48


def sample_uniform(df: DataFrame, key: str, seq: str, letters: str, n: int = 5000, least: int = 25, seed: str = "1") -> DataFrame:
    """``key, poi, aa`` of ``n`` draws: a sequence of ``least`` letters or more, each as likely as any other however long, then a
    place of the wanted letters in it that was not drawn before. Fewer, where all places are drawn. Keys are unique.

    A sequence's draws come at the times of a random process of rate one (sums of exponential steps from digests); the first ``n``
    of all sequences are independent uniform draws of sequences. Only times below a bound are made, at which about ``n`` draws are
    expected; the bound is doubled while that leaves too few. So sequences become rows only as often as they are drawn.
    """
    suitable = F.length(F.regexp_replace(seq, f"[^{letters}]", ""))
    long = df.filter(F.length(seq) >= least).select(F.col(key), F.col(seq), suitable.alias("places_")).filter("places_ > 0")
    totals = long.agg(F.count(F.lit(1)).alias("n"), F.max("places_").alias("places")).first()
    bound = (n + 6 * n**0.5 + 20) / max(1, totals.n)
    while True:
        most = int(20 + 4 * bound)  # draws of one sequence that are made at once
        step = F.transform(F.sequence(F.lit(1), F.least("places_", F.lit(most))), lambda j: -F.log(_uniform(F.col(key), seed, "t", j.cast("string"))))
        first = F.array(F.struct(F.lit(0.0).alias("t"), F.lit(0).alias("j")))
        times = F.aggregate(step, first, lambda made, s: F.concat(made, F.array(F.struct((F.element_at(made, -1)["t"] + s).alias("t"), (F.element_at(made, -1)["j"] + 1).alias("j")))))
        drawn = long.select(key, "places_", F.explode(F.slice(times, F.lit(2), F.size(times))).alias("d")).select(key, "places_", "d.t", "d.j").filter(F.col("t") <= bound)
        cut = (F.col("j") == most) & (F.col("places_") > most)  # further draws may lie below the bound
        state = drawn.agg(F.count(F.lit(1)).alias("n"), F.count_if(cut).alias("cut")).first()
        if not state.cut and (state.n >= n or most >= (totals.places or 0)):
            break
        bound *= 2
    picked = drawn.orderBy("t", key, "j").limit(n).groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("draws_"))  # the first draws of each sequence
    chosen = long.join(picked, key)
    # The j-th draw takes one of the places that are left, counted past those that were drawn.
    rest = F.transform(F.sequence(F.lit(1), F.col("draws_")), lambda j: F.floor(_uniform(F.col(key), seed, "p", j.cast("string")) * (F.col("places_") - j + 1)).cast("int"))
    past = lambda taken, r: F.aggregate(F.array_sort(taken), r, lambda at, c: at + (at >= c).cast("int"))
    nth = F.aggregate(rest, F.array().cast("array<int>"), lambda taken, r: F.concat(taken, F.array(past(taken, r))))
    at = F.filter(F.transform(F.split(seq, ""), lambda c, i: F.when(c.rlike(f"^[{letters}]$"), i + 1)), lambda i: i.isNotNull())
    spots = chosen.select(key, seq, at.alias("at_"), nth.alias("nth_")).select(key, seq, "at_", F.explode("nth_").alias("k_")).select(key, seq, F.get("at_", F.col("k_")).alias("poi"))
    return spots.select(key, "poi", F.substring(F.col(seq), F.col("poi"), F.lit(1)).alias("aa"))


def mark_samples(picked: DataFrame, df: DataFrame, key: str, seq: str) -> DataFrame:
    """Sampled positions with their sequence, a marker inserted after the residue."""
    marked = F.concat(F.substring(F.col(seq), F.lit(1), F.col("poi")), F.lit("*"), F.substring(F.col(seq), F.col("poi") + 1, F.length(seq)))
    return picked.join(df.select(key, seq), key).withColumn("marked", marked).drop(seq)
