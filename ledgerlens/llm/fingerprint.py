"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its lower-cased words with their counts. Sample k of a term with weight w draws r and c from
Gamma(2, 1) and beta from the uniform distribution, all from a hash of (term, k); with t = floor(ln w / r + beta) its key is
ln c - r (t - beta + 1). The term of the smallest key, with its t, is the text's k-th sample: two texts share it with a
probability equal to the generalised Jaccard similarity of their weights. r and ln c come from tables of quantiles.

All is Catalyst: words are hashed and sorted inside the row, runs give the counts, and one hash aggregate per (document,
version) takes the minima over its terms. Texts are shuffled once, by range bucket of doc_id.

Edge cases: null and empty texts have no terms and share one fingerprint (likeness 1 among themselves, 0 to others); a text
without words is one term; ids must be numbers; equal texts have equal fingerprints; repeated rows follow each other in the order; a single row is
its own successor; null ids come first; other columns are not read.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keyed, table
from .decontaminate import RAW_WORD
from .neighbours import with_successors

SAMPLES = 64
QUANTILE_BITS = 12
BETA_BITS = 20


def gamma_quantiles(n: int) -> np.ndarray:
    """The middle quantiles of Gamma(2, 1) in ``n`` equal parts, by bisection of 1 - (1 + x) e^-x."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 64.0)
    for _ in range(80):
        mid = (low + high) / 2
        above = 1 - (1 + mid) * np.exp(-mid) > p
        low, high = np.where(above, low, mid), np.where(above, mid, high)
    return (low + high) / 2


def looked_up(spark: SparkSession, values: np.ndarray) -> Column:
    """The values as a scalar subquery of one array, which keeps them out of the expressions that use them."""
    return spark.createDataFrame([([float(v) for v in values],)], "v array<double>").scalar()


def term_hashes(text: Column) -> Column:
    """Sorted hashes of the words; of the text itself if it has none but isn't empty."""
    words = F.regexp_extract_all(F.lower(text), F.lit(RAW_WORD), F.lit(0))
    words = F.when((F.size(words) == 0) & (text != ""), F.array(text)).otherwise(words)
    return F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))


def sample_key(term: Column, log_weight: Column, k: int, rs: Column, cs: Column) -> Column:
    """The k-th key of a term in the upper bits, with bits of its hash below them."""
    mask = (1 << QUANTILE_BITS) - 1
    z = F.xxhash64(term, F.lit(k))
    r = F.get(rs, z.bitwiseAND(F.lit(mask)).cast("int"))
    ln_c = F.get(cs, F.shiftrightunsigned(z, QUANTILE_BITS).bitwiseAND(F.lit(mask)).cast("int"))
    beta = F.shiftrightunsigned(z, 2 * QUANTILE_BITS).bitwiseAND(F.lit((1 << BETA_BITS) - 1)) / F.lit(float(1 << BETA_BITS))
    t = F.floor(log_weight / r + beta)
    key = ln_c - r * (t - beta + 1)
    return F.shiftleft((key * F.lit(float(1 << 20))).cast("long"), 28) + F.shiftrightunsigned(z, 36)


def signatures(texts: DataFrame, keys: list[str], text: str = "_text", samples: int = SAMPLES) -> DataFrame:
    """``keys`` and _sig, an array of ``samples`` keys, null for a text without terms. ``keys`` must tell the rows apart.

    No shuffle is added if ``texts`` is dealt by some of ``keys``.
    """
    edges = F.filter(F.sequence(F.lit(0), F.size("_terms") - 1), lambda i: (i == 0) | (F.get("_terms", i) != F.get("_terms", i - 1)))
    terms = texts.select(*keys, term_hashes(F.col(text)).alias("_terms"))
    terms = terms.withColumn("_edges", F.when(F.size("_terms") > 0, edges))
    terms = terms.select(*keys, "_terms", "_edges", F.posexplode_outer("_edges").alias("_i", "_at"))
    end = F.coalesce(F.get("_edges", F.col("_i") + 1), F.size("_terms"))
    terms = terms.select(*keys, F.get("_terms", F.col("_at")).alias("_term"), F.log((end - F.col("_at")).cast("double")).alias("_lw"))
    quantiles = gamma_quantiles(1 << QUANTILE_BITS)
    rs, cs = looked_up(texts.sparkSession, quantiles), looked_up(texts.sparkSession, np.log(quantiles))
    least = terms.groupBy(*keys).agg(*[F.min(sample_key(F.col("_term"), F.col("_lw"), k, rs, cs)).alias(f"_s{k}") for k in range(samples)])
    return least.select(*keys, F.when(F.col("_s0").isNotNull(), F.array(*[f"_s{k}" for k in range(samples)])).alias("_sig"))


def fingerprint(sig: Column) -> Column:
    """A signature as 16 bits of the hash of every sample."""
    return F.transform(sig, lambda x: F.xxhash64(x).bitwiseAND(F.lit(0xFFFF)))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples of two fingerprints."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return F.when(a.isNull() | b.isNull(), (a.isNull() & b.isNull()).cast("double")).otherwise(equal / F.size(a))


def shown(print_: Column, samples: int = SAMPLES) -> Column:
    """A fingerprint as text, in hex."""
    digits = F.array_join(F.transform(print_, lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))), "")
    return F.coalesce(digits, F.lit("0" * 4 * samples))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """_bucket, _n (order within it), _ghost, doc_id, _text, _edited: each text with its second half replaced by the next one's start."""
    order = ["doc_id", "_th"]
    rows = with_successors(keyed(docs, "doc_id"), order, "_text")
    by = Window.partitionBy("_bucket").orderBy("_ghost", *order)
    half = F.floor(F.length("_text") / 2).cast("int")
    rows = rows.withColumn("_next", F.lead("_text").over(by)).withColumn("_n", F.row_number().over(by))
    return rows.select("_bucket", "_n", "_ghost", "doc_id", "_text", F.concat(F.left("_text", F.length("_text") - half), F.left(F.coalesce("_next", F.lit("")), half)).alias("_edited"))


def op7_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, with their likeness and that of the next document."""
    pairs = edited_pairs(table(spark, sf_dir, "documents"))
    versions = F.array(F.struct(F.lit(0).alias("v"), F.col("_text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("_edited").alias("t")))
    keys = ["_bucket", "_n", "_ghost", "doc_id", "_v", "n_chars", "edited_sha256"]
    texts = pairs.withColumn("_x", F.explode(versions)).select(
        "_bucket", "_n", "_ghost", "doc_id", F.col("_x.v").alias("_v"), F.col("_x.t").alias("_text"),
        F.when(F.col("_x.v") == 1, F.sha2(F.col("_x.t"), 256)).alias("edited_sha256"), F.length("_x.t").cast("long").alias("n_chars"),
    )
    by = Window.partitionBy("_bucket").orderBy("_n", "_v")
    found = signatures(texts, keys).withColumn("_sig", fingerprint(F.col("_sig")))
    found = found.select(*keys, "_sig", F.lead("_sig", 1).over(by).alias("_own"), F.lead("_sig", 2).over(by).alias("_then"), F.lead("edited_sha256", 1).over(by).alias("_sha"))
    found = found.where((F.col("_v") == 0) & ~F.col("_ghost"))
    return found.select(
        "doc_id", "n_chars", F.col("_sha").alias("edited_sha256"), shown(F.col("_sig")).alias("fingerprint"), shown(F.col("_own")).alias("edited_fingerprint"),
        likeness(F.col("_sig"), F.col("_own")).alias("near_edited"), likeness(F.col("_sig"), F.col("_then")).alias("near_next"),
    )
