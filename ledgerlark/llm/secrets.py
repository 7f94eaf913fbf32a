"""Secret scan: pattern spans and spans by character Markov models.

Two first-order models over characters, one of random strings and one of ordinary identifiers, are trained
from labelled samples. A candidate token is a secret when the log-likelihood ratio of the two models, per
transition, is above a threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bound, constant_array, match_spans

# Patterns of the base scan, the least length that counts, in the order in which kinds are listed.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""^(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "markov"]

# Words that identifiers are commonly made of.
WORDS = (
    "account action address admin application array backend balance batch block buffer button bytes cache callback category channel character check class client cluster code collection column command comment commit component "
    "config connection constant container content context control controller convert count create currency current customer data database date default delete delivery dependency description detail device directory display document "
    "domain driver element email enabled encoding endpoint engine entity environment error event example exception execute export extension factory feature field file filter folder format frame framework function gateway global "
    "graph group handler header height history host identifier image import index information initialize input instance integer interface internal invoice item iterator java kernel label language layout length library license "
    "limit listener local location manager mapping maximum memory message metadata method minimum model module monitor name network notification number object offset operation option order output package parameter parent parser "
    "partition password path payment permission platform policy position prefix previous process product profile project property protocol provider public query queue reader record reference region register request resource response"
).split()
FIRST, ALPHABET = 32, 95  # printable ASCII; code 32 stands for "before the first character"


def kinded(kind: str, spans: str) -> str:
    return f"transform({spans}, s -> named_struct('start', s.start, 'rank', {KINDS.index(kind)}, 'kind', '{kind}', 'end', s.end, 'value', s.value))"


def base_spans(text: str) -> Column:
    """Array of (start, rank, kind, end, value) of the pattern kinds, by start, then kind as listed."""
    assign = f"filter({match_spans(text, ASSIGN)}, s -> char_length(regexp_extract(s.value, r'{ASSIGN_HEAD}', 1)) >= 6)"
    # Runs of [A-Z0-9] and [0-9a-f] are maximal, so asking for the length in the pattern finds the same matches.
    kinds = [("assign", assign), ("access", match_spans(text, ACCESS)), ("hex", match_spans(text, HEX))]
    return F.expr(f"sort_array(concat({', '.join(kinded(k, spans) for k, spans in kinds)}))")


def random_strings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """(text, random) of n random strings, a fifth each in base64, letters and digits, capitals and digits, small letters and digits, hex.

    They come from hashes of numbers, so they are the same everywhere.
    """
    base64 = "base64(unhex(sha2(cast(id as string), 256)))"
    plain = f"regexp_replace({base64}, '[^A-Za-z0-9]', '')"
    kinds = [f"rtrim('=', {base64})", plain, f"upper({plain})", f"lower({plain})", "substr(sha2(cast(id as string), 256), 1, 32)"]
    text = " ".join(f"when {k} then {kind}" for k, kind in enumerate(kinds))
    return spark.range(n).selectExpr(f"case id % {len(kinds)} {text} end as text", "true as random")


def labelled_samples(docs: DataFrame, most_docs: int = 2_000, n_random: int = 6000) -> DataFrame:
    """(text, random) samples: random strings of several alphabets against identifiers made of ordinary words.

    A classifier may be fitted on a bounded sample: the words are those of four letters and more of about
    `most_docs` rows, chosen by a hash of doc_id, each word once, and a fixed list in several orders. Identifiers are words alone, capitalised, in capitals, and
    neighbouring ones joined by `_`, by `-` and by capitals, with a small number at the end of one in four.
    """
    n = docs.count()
    rows = docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 50)) < int(min(1.0, most_docs / max(n, 1)) * (1 << 50)))
    fixed = docs.sparkSession.range(40).select(F.expr(f"transform(sequence(0, {len(WORDS) - 1}), i -> get(split('{' '.join(WORDS)}', ' '), cast((i * (1 + id * 2) + id) % {len(WORDS)} as int)))").alias("w"))
    words = rows.select(F.explode(F.expr(r"array_distinct(regexp_extract_all(coalesce(cast(text as string), ''), r'(?<![A-Za-z0-9])[A-Za-z]{4,}(?![A-Za-z0-9])', 0))")).alias("w")).distinct()
    # Distinct words, dealt out by a hash into about as many rows as there were documents.
    rows = words.groupBy(F.pmod(F.xxhash64("w"), F.lit(most_docs)).alias("k")).agg(F.sort_array(F.collect_list("w")).alias("w")).select("w").unionByName(fixed)
    at = lambda k: f"coalesce(get(w, i + {k}), '')"
    forms = [at(0), f"initcap({at(0)})", f"upper({at(0)})", f"concat_ws('_', lower({at(0)}), lower({at(1)}), lower({at(2)}))", f"concat_ws('-', lower({at(0)}), lower({at(1)}))", f"concat(lower({at(0)}), initcap({at(1)}), initcap({at(2)}))"]
    form = " ".join(f"when {k} then {x}" for k, x in enumerate(forms))
    ended = f"concat(case i % {len(forms)} {form} end, if(i % 4 = 0, cast(1 + i % 2030 as string), ''))"
    ordinary = rows.select(F.explode(F.expr(f"array_distinct(transform(w, (x, i) -> {ended}))")).alias("text"), F.lit(False).alias("random"))
    return ordinary.unionByName(random_strings(docs.sparkSession, n_random)) if n_random else ordinary


def codes(token: str) -> str:
    """SQL for the characters of a token as small integers; null for what is not printable ASCII."""
    return f"transform(split({token}, ''), c -> if(ascii(c) between {FIRST + 1} and {FIRST + ALPHABET - 1}, ascii(c) - {FIRST}, null))"


def train(samples: DataFrame, uniform: float = 50.0, backoff: float = 5.0) -> list[float]:
    """Log-likelihood ratios, random over ordinary, of each transition, as a table of 95 x 95 doubles.

    `samples` has text and random (boolean). Random strings are near uniform over the 65 characters of
    tokens, so their model starts from `uniform` pseudo-counts spread over them; the other backs off to the
    frequency of the character with the weight `backoff`. Without samples of both labels the ratios are zero
    and nothing is found. The counts that reach the driver are bounded by the alphabet.
    """
    steps = bound(codes("text"), "t", "transform(t, (c, i) -> named_struct('a', if(i = 0, 0, get(t, i - 1)), 'b', c))")
    pairs = samples.where(F.char_length("text") > 0).select("random", F.explode(F.expr(steps)).alias("p"))
    counts = pairs.where("p.a is not null and p.b is not null").groupBy("random", F.col("p.a").alias("a"), F.col("p.b").alias("b")).count().collect()
    seen: dict[bool, dict[tuple[int, int], int]] = {True: {}, False: {}}
    for r in counts:
        if r["random"] is not None:
            seen[r["random"]][r["a"], r["b"]] = r["count"]
    table = [0.0] * (ALPHABET * ALPHABET)
    if not seen[True] or not seen[False]:
        return table
    size, letters = 65, {b: 0.5 for b in range(1, ALPHABET)}
    for (_, b), n in seen[False].items():
        letters[b] += n
    every = sum(letters.values())
    for a in range(ALPHABET):
        total = {k: sum(n for (x, _), n in seen[k].items() if x == a) for k in seen}
        for b in range(1, ALPHABET):
            p = (seen[True].get((a, b), 0) + uniform / size) / (total[True] + uniform)
            q = (seen[False].get((a, b), 0) + backoff * letters[b] / every) / (total[False] + backoff)
            table[a * ALPHABET + b] = math.log(p / q)
    return table


def llr(token: str, table: str) -> str:
    """SQL for the mean log-likelihood ratio per transition of a token of printable ASCII."""
    step = f"coalesce(get({table}, if(i = 0, 0, get(t, i - 1)) * {ALPHABET} + c), 0d)"
    return bound(codes(token), "t", f"aggregate(transform(t, (c, i) -> {step}), 0d, (acc, x) -> acc + x) / greatest(size(t), 1)")


def scan(docs: DataFrame, table: list[float], threshold: float = 0.5, least: int = 20) -> DataFrame:
    """doc_id and the array `spans` of (start, rank, kind, end, value) of each row, by start and kind.

    Kinds assign, access and hex come from patterns; markov adds tokens of `least` or more characters that
    lie apart from those, whose ratio exceeds `threshold`. Positions
    are code points, ends exclusive. Null and empty texts have no spans; repeated rows get the same spans
    each; a null doc_id is kept; an empty table gives no rows. Texts are scanned whole. Other columns of
    `docs` are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tokens = F.expr(match_spans("text", f"[A-Za-z0-9+/_=-]{{{least},}}"))
    rows = rows.select("doc_id", base_spans("text").alias("base"), tokens.alias("tokens"))
    apart = F.expr("filter(tokens, t -> not exists(base, b -> b.start < t.end and t.start < b.end))")
    rows = rows.select("doc_id", "base", apart.alias("tokens"), constant_array(table).alias("ratios"))
    added = f"filter(tokens, t -> {llr('t.value', 'ratios')} > {threshold}d)"
    return rows.select("doc_id", F.expr(f"sort_array(concat(base, {kinded('markov', added)}))").alias("spans"))
