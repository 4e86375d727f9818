"""Order MinHash document fingerprints, with DataFrame functions only.

A text is split by its content alone, by one rule for all texts (``TOKEN``): white space separates, in runs
of Latin letters, digits and signs a piece of five characters or more ends behind the next of
``aeo0369``, and every character of another script is a piece. So an edit changes the pieces around it
and no others, with or without spaces. K-mers are ``K`` consecutive pieces. Equal k-mers are told apart by their occurrence number. Every (k-mer,
occurrence) gets a hash that names one of ``BINS`` bins and a rank in it. Each bin selects its
``L`` smallest elements, puts them back in text order and hashes the tuple, so a signature entry
agrees only where the same k-mers were selected *in the same order*, which is what makes it
sensitive to edit distance. The likeness of two fingerprints is the share of equal entries among
the bins that either one fills.

Per text the work is one split, one sort of 64-bit numbers and one scan that keeps a few hundred
candidates (the smallest ranks); where a bin gets fewer than ``L`` of them the text is scanned again
with all elements, so the selection is always exact. No row is exploded and nothing but the text
itself and a third of its neighbour's is shuffled.

Defined results: null is the empty text; a text without a piece has one empty piece; equal texts have equal
fingerprints; rows that share an id stand in for each other (the largest value is the neighbour
that others see); a null id sorts before all numbers; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import materialise

K, L, BINS, KEPT = 4, 2, 32, 400
#: An element is 64 bits: its bin (5), its rank in the bin (31), its k-mer's position in the text (28).
_POS, _RANK = 28, 31
_ALL = 2**_RANK
_NO_ID = -(2**63)


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


#: Runs of Latin without a character to end a piece are cut after 40; that takes 40 characters without one.
TOKEN = (
    r"[\\x{0250}-\\x{10FFFF}]|[^\\s\\x{0250}-\\x{10FFFF}]{4,40}?[aeoAEO0369]|[^\\s\\x{0250}-\\x{10FFFF}]{1,40}+"
)


def _words(text: str) -> str:
    """The pieces of a text."""
    return _let("ws", f"regexp_extract_all({text}, '{TOKEN}', 0)", "IF(size(ws) = 0, array(''), ws)")


def _sorted_kmers(words: str) -> str:
    """Elements of all k-mers, as if none stood twice, ascending."""
    rest = "".join(f", get({words}, i + {j})" for j in range(1, K))
    return f"sort_array(transform({words}, (x, i) -> (xxhash64(x{rest}) & {-(2**_POS)}L) + i))"


def _kmer(x: str) -> str:
    return f"shiftright({x}, {_POS})"


def _bin(x: str) -> str:
    return f"shiftrightunsigned({x}, {_POS + _RANK})"


def _later(kmers: str, below: str) -> str:
    """Elements of second and later occurrences, by (k-mer, occurrence), with a rank under ``below``."""
    again = f"filter({kmers}, (s, i) -> i > 0 AND {_kmer('s')} = {_kmer(f'get({kmers}, i - 1)')})"
    occ = f"IF({_kmer('s')} = st.prev, st.occ + 1, 1)"
    element = f"(xxhash64({_kmer('s')}, {occ}) & {-(2**_POS)}L) + (s & {2**_POS - 1}L)"
    return (
        f"aggregate({again}, named_struct('prev', CAST(NULL AS BIGINT), 'occ', 0, 'got', CAST(array() AS ARRAY<BIGINT>)), "
        f"(st, s) -> named_struct('prev', {_kmer('s')}, 'occ', {occ}, "
        f"'got', IF(({element} & {(_ALL - 1) << _POS}L) < {below}, array_append(st.got, {element}), st.got)), st -> st.got)"
    )


def _candidates(kmers: str, below: str) -> str:
    """Elements with a rank under ``below`` (shifted), ascending: first occurrences and later ones."""
    low = f"filter({kmers}, s -> (s & {(_ALL - 1) << _POS}L) < {below})"
    firsts = "filter(low, (s, i) -> i = 0 OR " + f"{_kmer('s')} <> {_kmer('get(low, i - 1)')})"
    distinct = f"size(array_distinct(transform({kmers}, s -> {_kmer('s')}))) = size({kmers})"
    return f"IF({distinct}, {low}, {_let('low', low, f'sort_array(concat({firsts}, {_later(kmers, below)}))')})"


def _entries(got: str) -> str:
    """Entry of each bin from its sorted candidates: bin -> hash of its first L in text order."""
    pos = lambda x: f"({x} & {2**_POS - 1}L)"
    second = f"get({got}, i + 1)"
    pair = f"IF({pos('x')} < {pos(second)}, xxhash64({_kmer('x')}, {_kmer(second)}), xxhash64({_kmer(second)}, {_kmer('x')}))"
    one = f"IF({_bin(second)} = {_bin('x')}, {pair}, xxhash64({_kmer('x')}))"
    first = f"i = 0 OR {_bin('x')} <> {_bin(f'get({got}, i - 1)')}"
    return (
        f"map_from_entries(filter(transform({got}, (x, i) -> IF({first}, "
        f"named_struct('k', CAST({_bin('x')} AS INT), 'v', {one}), NULL)), x -> x IS NOT NULL))"
    )


def _full_bins(got: str) -> str:
    """Bins with at least L candidates."""
    first = f"(i = 0 OR {_bin('x')} <> {_bin(f'get({got}, i - 1)')})"
    return f"size(filter({got}, (x, i) -> {first} AND {_bin(f'get({got}, i + {L - 1})')} = {_bin('x')}))"


def fingerprint(text: str) -> Column:
    """A string of 8 hex digits per bin ('-' * 8 for an empty bin) for the column ``text``."""
    below = f"CAST({float(_ALL << _POS)}D * least(1D, {KEPT}D / size(w)) AS BIGINT)"
    lacking = f"size(w) > {KEPT} AND {_full_bins('few')} < {BINS}"
    entry = "lpad(right(lower(hex(m[CAST(b AS INT)])), 8), 8, '0')"
    shown = f"IF(map_contains_key(m, CAST(b AS INT)), {entry}, '--------')"
    body = _let("m", _entries("got"), f"array_join(transform(sequence(0, {BINS - 1}), b -> {shown}), '')")
    body = _let("got", f"IF({lacking}, {_candidates('kmers', f'{_ALL << _POS}L')}, few)", body)
    body = _let("few", _candidates("kmers", "bar"), body)
    body = _let("kmers", _sorted_kmers("w"), _let("bar", below, body))
    return F.expr(_let("w", _words(f"coalesce({text}, '')"), body))


def likeness(a: str, b: str) -> Column:
    """Share of equal entries among bins that either fingerprint fills (0 to 1); null if one is null."""
    part = lambda x: f"substr({x}, 8 * k + 1, 8)"
    either = f"size(filter(sequence(0, {BINS - 1}), k -> NOT ({part(a)} = '--------' AND {part(b)} = '--------')))"
    same = f"size(filter(sequence(0, {BINS - 1}), k -> {part(a)} = {part(b)} AND {part(a)} <> '--------'))"
    return F.expr(f"IF({a} = {b}, 1D, coalesce(try_divide(CAST({same} AS DOUBLE), {either}), 0D))")


def neighbours(docs: DataFrame) -> DataFrame:
    """(k, n, next, reader, reader_n): by falling id, whom each id is followed by, and whom it follows.

    Ids are dealt by range and written; rows look left and right within their range, and a table of
    one row per range joins the ranges' ends. The ring closes from the smallest to the largest id.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.groupBy("k").agg(F.max(F.char_length("text")).alias("n"))
    dealt = ids.repartitionByRange(parts, "k").withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt, "ids")
    ends = dealt.groupBy("part").agg(F.max("k").alias("last"), F.min(F.struct("k", "n")).alias("first"))
    over = W.orderBy("part")
    ends = ends.select(
        "part",
        F.coalesce(F.lag("last").over(over), F.max("last").over(W.partitionBy())).alias("before"),
        F.coalesce(F.lead("first").over(over), F.min("first").over(W.partitionBy())).alias("after"),
    )
    within = W.partitionBy("part").orderBy("k")
    return (
        dealt.withColumn("down", F.lag("k").over(within))
        .withColumn("up", F.lead(F.struct("k", "n")).over(within))
        .join(F.broadcast(ends), "part")
        .select(
            "k",
            "n",
            F.coalesce("down", "before").alias("next"),
            F.coalesce("up", "after").getField("k").alias("reader"),
            F.coalesce("up", "after").getField("n").alias("reader_n"),
        )
    )


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and their likeness.

    The edited text has its last third of code points replaced by as many (or all) first ones of the
    next document by falling id; after the last comes the first.
    """
    base = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("k"), F.coalesce("text", F.lit("")).alias("text")
    )
    ring = materialise(neighbours(base), "ring")
    known = base.join(ring, "k")
    heads = (
        known.select(F.col("reader").alias("k"), F.expr("left(text, CAST(floor(reader_n / 3) AS INT))").alias("head"))
        .groupBy("k")
        .agg(F.max("head").alias("head"))
    )
    both = known.select("k", "next", "text").join(heads, "k")
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    both = both.withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.expr("left(text, char_length(text) - CAST(floor(char_length(text) / 3) AS INT))"), F.substring(F.col("head"), F.lit(1), cut))
    )
    both = both.withColumn("fingerprint", fingerprint("text")).withColumn(
        "edited_fingerprint", fingerprint("edited")
    )
    done = materialise(
        both.select(
            "k",
            "next",
            "n_chars",
            F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            "fingerprint",
            "edited_fingerprint",
        ),
        "prints",
    )
    seen = done.groupBy(F.col("k").alias("next")).agg(F.max("fingerprint").alias("next_fingerprint"))
    return done.join(seen, "next").select(
        F.when(F.col("k") != _NO_ID, F.col("k")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
