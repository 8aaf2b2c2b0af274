"""Entities named in a question, matched longest first and consumed on match.

Keys are found by an equality join on substrings, never by testing every key
against every question: a match ends where a non-word character (or the end)
follows, so the candidates of a question are the substrings that end there and
have the length of some key.  A bitmap of the hashes of all keys, of bounded size,
goes to every task and drops nearly all other substrings before they are joined;
what it lets through wrongly the join drops.  The last characters of the keys have
such a bitmap too, so substrings are cut only where some key can end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquery.functions.text import WHITESPACE_CLASS, stem, truthy
from folioquery.sources.tables import shuffled, stage

#: Bits of the key filter: so many to a key, between the bounds. A filter that is too small only lets more through.
BITS_PER_KEY = 32
MIN_BITS = 1 << 12
MAX_BITS = 1 << 26

#: So many last characters of a key are looked up first: the largest of these that its length reaches.
TAILS = (8, 4, 1)

_KEY = "struct<neg_len:int,csv_ord:bigint,key_ord:int,key:string,doc_id:string>"


def vocabulary(metadata: DataFrame, indexed: DataFrame | None = None) -> DataFrame:
    """Routing keys: company and file stem of each report, limited to indexed ones.

    ``metadata`` has company, filename and csv_ord, its row order.
    """
    rows = metadata.withColumn("doc_id", stem(F.col("filename")))
    if indexed is not None:
        rows = rows.join(indexed.select("doc_id").distinct(), "doc_id", "left_semi")
    keys = F.array(
        F.struct(F.lit(0).alias("key_ord"), F.col("company").alias("key")),
        F.struct(F.lit(1).alias("key_ord"), F.col("doc_id").alias("key")),
    )
    return (
        rows.select("doc_id", "csv_ord", F.inline(keys))
        .where(truthy(F.col("key")).isNotNull())
        .select("doc_id", "key", F.col("csv_ord").cast("long").alias("csv_ord"), "key_ord")
    )


def _pattern(key: Column) -> Column:
    quoted = F.replace(key, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("(?iU)\\Q"), quoted, F.lit("\\E(?:\\W|$)"))


def _fold(text: Column) -> Column:
    """Lower case of the same length: letters whose lower case is longer stay as they are."""
    low = F.lower(text)
    letters = F.transform(F.split(text, ""), lambda c: F.when(F.length(F.lower(c)) == F.length(c), F.lower(c)).otherwise(c))
    return F.when(F.length(low) == F.length(text), low).otherwise(F.array_join(letters, ""))


def _bit(low: Column, n_bits: int) -> Column:
    return F.pmod(F.xxhash64(low), F.lit(n_bits))


def _tail(length: Column) -> Column:
    """How many last characters of a key of this length are looked up."""
    return F.coalesce(*[F.when(length >= n, n) for n in TAILS])


def key_filter(hashed: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """One row with the bitmap of the texts ``low`` as 64-bit words, and its number of bits."""
    n_bits = MIN_BITS
    while n_bits < BITS_PER_KEY * n_keys and n_bits < MAX_BITS:
        n_bits *= 2
    words = hashed.select(_bit(F.col("low"), n_bits).alias("b")).groupBy(F.shiftright("b", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 64).cast("int"))).alias("bits")
    )
    every = hashed.sparkSession.range(n_bits // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    ordered = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return stage(every.agg(F.transform(ordered, lambda w: w["bits"]).alias("bits")), "key-filter"), n_bits


def key_filters(keys: DataFrame) -> tuple[tuple[DataFrame, int], tuple[DataFrame, int], DataFrame]:
    """Bitmaps of the folded keys and of their tails, and one row with the key lengths of each tail length."""
    n_keys = keys.count()
    low = keys.select(_fold(F.col("key")).alias("low"))
    ends = low.select(F.right("low", _tail(F.length("low"))).alias("low"))
    lengths = keys.select(F.length("key").alias("n")).groupBy(_tail(F.col("n")).alias("tail")).agg(
        F.array_sort(F.collect_set("n")).alias("lengths")
    )
    kinds = stage(lengths.agg(F.array_sort(F.collect_list(F.struct("tail", "lengths"))).alias("kinds")), "key-lengths")
    return key_filter(low, n_keys), key_filter(ends, n_keys), kinds


def _passes(low: Column, passing: tuple[DataFrame, int]) -> Column:
    bitmap, n_bits = passing
    at = _bit(low, n_bits)
    word = F.get(bitmap.scalar(), F.shiftright(at, 6).cast("int"))
    return F.call_function("shiftrightunsigned", word, (at % 64).cast("int")).bitwiseAND(1) == 1


def _candidates(
    open_questions: DataFrame, keys: DataFrame, filters: tuple[tuple[DataFrame, int], tuple[DataFrame, int], DataFrame],
    again: bool,
) -> DataFrame:
    """Keys that occur in the remaining text, in consuming order, per question."""
    whole, tails, kinds = filters
    text = _fold(F.col("rest"))
    # a piece ends where a non-word character or the end follows
    pieces = F.regexp_extract_all("rest", F.lit(r"(?U)^\w+|\W\w*"), F.lit(0))
    end = F.length(F.array_join(F.slice("_pieces", F.lit(1), F.col("_piece") + 1), ""))
    # outer forms of what is never empty: the plain ones would work out their arrays once more for a filter
    spots = (
        open_questions.where(F.length("rest") > 0)
        .select("question_id", text.alias("_text"), "last", pieces.alias("_pieces"))
        .select("question_id", "last", "_text", "_pieces", F.posexplode_outer("_pieces").alias("_piece", "_"))
        .select("question_id", "last", "_text", end.alias("_end"))
        .select("question_id", "last", "_text", "_end", F.inline_outer(kinds.scalar()))
        # in the scan's tasks: hardly anything but keys goes on
        .where(F.col("tail") <= F.col("_end"))
        .where(_passes(F.substring("_text", F.col("_end") - F.col("tail") + 1, F.col("tail")), tails))
        .select("question_id", "last", "_text", "_end", F.explode_outer("lengths").alias("_n"))
        .where(F.col("_n") <= F.col("_end"))
        .select("question_id", "last", F.substring("_text", F.col("_end") - F.col("_n") + 1, F.col("_n")).alias("_low"))
        .where(_passes(F.col("_low"), whole))
        .groupBy("question_id", "last", "_low").agg(F.count(F.lit(1)).alias("_times"))
    )
    same_key = Window.partitionBy("_low").orderBy("csv_ord", "key_ord")
    ranked = keys.withColumn("_low", _fold(F.col("key"))).withColumn(
        "_nth", F.row_number().over(same_key)
    )
    entry = F.struct(
        (-F.length("key")).alias("neg_len"), "csv_ord", "key_ord", "key",
        F.col("doc_id").cast("string").alias("doc_id"),
    ).cast(_KEY)
    # Each occurrence is consumed once, so of the reports sharing a key that are
    # still to come only as many as it occurs can be hit.
    if again:
        found = spots.join(ranked, "_low").withColumn("_entry", entry).where(
            F.col("last").isNull() | (F.col("_entry") > F.col("last"))
        )
        coming = Window.partitionBy("question_id", "_low").orderBy("_entry")
        found = found.withColumn("_nth", F.row_number().over(coming))
    else:
        found = spots.join(ranked, "_low").withColumn("_entry", entry)
    return (
        found.where(F.col("_nth") <= F.col("_times"))
        .groupBy("question_id").agg(F.array_sort(F.collect_set("_entry")).alias("keys"))
    )


def _consume(rest: Column, hits: Column, keys: Column, irregular: Column) -> Column:
    """Fold the keys over the text; stops where a removal may have made a new match.

    Removing a match that follows white space cannot: what is left there is white
    space next to white space, which regular keys never contain.
    """
    state_type = f"struct<rest:string,hits:array<string>,stopped:boolean,last:{_KEY}>"

    def visit(s: Column, k: Column) -> Column:
        # one-element arrays make the pattern and its match lambda variables: each is worked out once per key
        match = F.transform(F.array(_pattern(k["key"])), lambda pattern: F.struct(
            F.regexp_instr(s["rest"], pattern).alias("at"), F.regexp_substr(s["rest"], pattern).alias("found")
        ))
        return F.when(s["stopped"], s).otherwise(F.transform(match, lambda m: take(s, k, m["at"], m["found"]))[0])

    def take(s: Column, k: Column, at: Column, found: Column) -> Column:
        before = F.substring(s["rest"], F.lit(1), at - 1)
        glued = (at > 1) & ~F.substring(s["rest"], at - 1, F.lit(1)).rlike(f"[{WHITESPACE_CLASS}]")
        consumed = F.struct(
            F.concat(before, F.lit(" "), F.substring(s["rest"], at + F.length(found), F.length(s["rest"])))
            .alias("rest"),
            F.concat(s["hits"], F.array(k["doc_id"])).alias("hits"),
            (glued | irregular).alias("stopped"),
            k.alias("last"),
        ).cast(state_type)
        return F.when(at == 0, s).otherwise(consumed)

    initial = F.struct(
        rest.alias("rest"), hits.alias("hits"), F.lit(False).alias("stopped"),
        F.lit(None).cast(_KEY).alias("last"),
    ).cast(state_type)
    return F.aggregate(keys, initial, visit)


def route_questions(questions: DataFrame, keys: DataFrame) -> DataFrame:
    """Add ``doc_ids``: reports named in each question, in order of their keys.

    ``questions`` has question_id and question.  Questions whose remaining text
    could hold a match that the question did not are matched again on that text,
    in rounds, until none is left; there is at most one round per name in a question.
    """
    if keys.isEmpty():
        raise ValueError("no report to route to: the metadata and the index have none in common")
    edge = f"^[{WHITESPACE_CLASS}]|[{WHITESPACE_CLASS}]$|[{WHITESPACE_CLASS}]{{2}}"
    irregular = keys.agg(
        F.coalesce(F.bool_or(F.col("key").rlike(edge)), F.lit(False)).alias("_irregular")
    )
    current = questions.select(
        "question_id", F.col("question").alias("rest"),
        F.array().cast("array<string>").alias("hits"), F.lit(None).cast(_KEY).alias("last"),
    ).repartition("question_id")  # as the join below asks for: the substrings are then cut in many tasks
    done: DataFrame | None = None
    filters = key_filters(keys)
    while True:
        folded = stage(
            current.join(
                _candidates(current, keys, filters, again=done is not None), "question_id", "left"
            )
            .withColumns({
                "keys": F.coalesce("keys", F.array().cast(f"array<{_KEY}>")),
                "_irregular": irregular.scalar(),
            })
            .select(
                "question_id",
                _consume(F.col("rest"), F.col("hits"), F.col("keys"), F.col("_irregular"))
                .alias("s"),
            )
            .select("question_id", "s.*"),
            "routes",
        )
        finished = folded.where(~F.col("stopped"))
        done = finished if done is None else done.unionByName(finished)
        current = folded.where("stopped").select("question_id", "rest", "hits", "last")
        if current.isEmpty():
            break
    routes = done.select("question_id", F.array_distinct("hits").alias("doc_ids"))
    return questions.join(shuffled(routes), "question_id")


def dispatch(doc_ids: Column) -> Column:
    """How a question is answered, by the number of reports it names."""
    n = F.size(doc_ids)
    return F.when(n == 0, "unanswerable").when(n == 1, "single").otherwise("comparative")
