"""Fill-in-the-middle transformation by overlapping chunks.

A text is tokens of white space and the word behind it; white space at the end is a token of its own. So a token begins at every place where
a character that is no white space is followed by one that is: this predicate of two adjacent characters is all that has to be counted.
A text is dealt into chunks of `chunk` characters which overlap by one, so that a pair at a seam is seen by the later chunk. Boundaries are counted chunk by chunk,
each count independent of all others; running sums of the counts tell which chunk owns each of the two cut ranks, and only these two
chunks are scanned again for the places. No array of the text's tokens is made, and no text leaves its row: one narrow pass of Spark expressions.

Ranks, form and order come from the SHA-256 of seed and id, so reruns agree. The sentinels are `<P>`, `<S>` and `<M>`; a text that holds one stays plain,
and neither end of a part can make one up, since a sentinel begins with `<` and ends with `>` and these are found once in three characters; so `restored` is exact.

Nulls: a null text is empty, an empty text is plain with no token; a null doc_id counts as an empty id. Repeated rows are treated
alike. An empty table gives no rows. Long texts cost one pass and two chunks. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, read

CHUNK, SEED, RATE, SPM_SHARE = 4096, 42, 50, 80
SPACE, OTHER = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"


def with_overlap(chunks: Column) -> Column:
    """Each chunk behind the last character of the one before it."""
    return F.transform(chunks, lambda c, k: F.when(k == 0, c).otherwise(F.concat(F.right(F.get(chunks, k - 1), F.lit(1)), c)))


def chunk_counts(text: Column, chunk: int = CHUNK) -> Column:
    """array<struct<view, chars, n>>: overlapping chunks, their own length and the token boundaries in them."""
    return let(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)),
        lambda chunks: F.transform(
            F.arrays_zip(with_overlap(chunks).alias("view"), F.transform(chunks, F.length).alias("chars")),
            lambda c: F.struct(c["view"].alias("view"), c["chars"].alias("chars"), F.regexp_count(c["view"], F.lit(OTHER + SPACE)).alias("n")),
        ),
    )


def total(counted: Column) -> Column:
    """Number of tokens: boundaries and the text's own start."""
    return F.aggregate(counted, F.lit(0).cast("long"), lambda n, c: n + c["n"]) + F.when(F.size(counted) > 0, 1).otherwise(0)


def owners(counted: Column, ranks: tuple[Column, ...]) -> Column:
    """array<struct<view, at, rank>>: for each rank the chunk that owns it, where its view starts in the text, and the rank inside it; null at the text's start and end."""
    owner = "struct<view: string, at: long, rank: long>"
    none = F.lit(None).cast(owner)
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("chars"), F.array(*(none for _ in ranks)).alias("found"))

    def step(done: Column, c: Column) -> Column:
        here = F.struct(c["view"].alias("view"), (done["chars"] + c["chars"] - F.length(c["view"])).cast("long").alias("at"))

        def route(rank: Column, k: int) -> Column:
            mine = (rank > done["seen"]) & (rank <= done["seen"] + c["n"])
            return F.when(mine, F.struct(here["view"].alias("view"), here["at"].alias("at"), (rank - done["seen"]).alias("rank")).cast(owner)).otherwise(F.get(done["found"], F.lit(k)))

        return F.struct((done["seen"] + c["n"]).alias("seen"), (done["chars"] + c["chars"]).alias("chars"), F.array(*(route(r, k) for k, r in enumerate(ranks))).alias("found"))

    return F.aggregate(counted, start, step, lambda done: done["found"])


def place(owner: Column) -> Column:
    """Characters of the text before the boundary that the owner holds: its chunk is scanned again, all others are not."""
    pieces = F.slice(F.regexp_extract_all(owner["view"], F.lit(rf"{SPACE}*+{OTHER}++(?={SPACE})"), F.lit(0)), F.lit(1), owner["rank"].cast("int"))
    return owner["at"] + F.aggregate(pieces, F.lit(0).cast("long"), lambda n, p: n + F.length(p))


def draw(doc_id: Column, k: int, seed: int = SEED) -> Column:
    """The k-th 32-bit number that belongs to an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def restored(output: Column, form: Column) -> Column:
    """The text rebuilt from an output and its form."""
    parts = F.split(output, "<[PSM]>")
    return F.when(form == "plain", output).otherwise(let(parts, lambda p: F.when(form == "psm", F.concat(F.get(p, F.lit(1)), F.get(p, F.lit(3)), F.get(p, F.lit(2)))).otherwise(F.concat(F.get(p, F.lit(2)), F.get(p, F.lit(3)), F.get(p, F.lit(1))))))


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm_share: int = SPM_SHARE, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars, output of every row; rate and spm_share are percentages."""
    text, doc_id = F.coalesce("text", F.lit("")), F.col("doc_id")
    plain = (F.length(text) == 0) | text.rlike("<[PSM]>") | (draw(doc_id, 3, seed) % 100 >= rate)
    form = F.when(plain, "plain").when(draw(doc_id, 4, seed) % 100 < spm_share, "spm").otherwise("psm")
    wide = docs.select("doc_id", text.alias("text"), form.alias("form"), draw(doc_id, 1, seed).alias("h1"), draw(doc_id, 2, seed).alias("h2"))

    def cuts(counted: Column) -> Column:
        def at(n: Column) -> Column:
            first, second = F.col("h1") % (n + 1), F.col("h2") % (n + 1)
            ranks = (F.least(first, second), F.greatest(first, second))
            end = lambda rank, owner: F.when(rank == 0, F.lit(0).cast("long")).when(rank == n, F.length("text").cast("long")).otherwise(place(owner))
            found = let(owners(counted, ranks), lambda o: F.array(*(end(r, F.get(o, F.lit(k))) for k, r in enumerate(ranks))))
            return F.struct(n.alias("n"), F.when(F.col("form") != "plain", found).alias("cut"))

        return let(total(counted), at)

    cut = wide.withColumn("cuts", let(chunk_counts(F.col("text"), chunk), cuts)).select("doc_id", "text", "form", "cuts.n", F.col("cuts.cut")[0].alias("a"), F.col("cuts.cut")[1].alias("b"))
    part = lambda start, length: F.substr("text", start.cast("int"), length.cast("int"))
    prefix, middle, suffix = part(F.lit(1), F.col("a")), part(F.col("a") + 1, F.col("b") - F.col("a")), part(F.col("b") + 1, F.length("text") - F.col("b"))
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit("<P>"), prefix, F.lit("<S>"), suffix, F.lit("<M>"), middle))
        .otherwise(F.concat(F.lit("<S>"), suffix, F.lit("<P>"), prefix, F.lit("<M>"), middle))
    )
    return cut.select("doc_id", "n", "form", F.col("a").alias("prefix_chars"), (F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"))


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(read(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM documents),
e AS (
  SELECT doc_id, t, w, len(w)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(w) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(w) + 1) AS b,
         CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
f AS (
  SELECT doc_id, t, n, form, array_to_string(w[1:least(a, b)], '') AS p, array_to_string(w[least(a, b) + 1:greatest(a, b)], '') AS m,
         array_to_string(w[greatest(a, b) + 1:], '') AS s FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM f
"""
