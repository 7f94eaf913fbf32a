"""URL filter: host and path rules first, else logistic regression on hashed character n-grams."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bound, constant_array, lower_ascii

# Fixed values: (host, path, verdict).
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

# Words that stand in the names of unwanted sites in English, German, French, Spanish, Italian and Portuguese.
UNWANTED = (
    "casino poker roulette blackjack baccarat jackpot slots bingo lottery bet odds betting bookmaker sportsbook wager gambling wetten gluecksspiel spielbank lotto parier apuestas loteria scommesse apostas "
    "viagra cialis levitra tramadol xanax pills pillen pastillas pillole steroids porn porno pornos xxx sex sexo sesso escort hentai camgirls nude nackt desnudas erotik adult "
    "ads adserver adclick banner popup popunder tracking tracker clickbait affiliate redirect spam spammer phishing malware trojan spyware botnet warez crack keygen serials torrent hacks "
    "payday loans kredit schnellgeld credito forex replica weightloss abnehmen miracle clickhere giveaway getrich"
).split()
# Words that stand in the names of ordinary sites in the same languages.
ORDINARY = (
    "news daily journal zeitung nachrichten gazette noticias giornale jornal weather wetter meteo library bibliothek biblioteca school schule ecole escuela scuola university universitaet college museum musee museo "
    "garden garten jardin giardino recipes rezepte recettes recetas ricette travel reisen voyage viajes viaggi history geschichte histoire historia storia science wissenschaft ciencia music musik musique musica "
    "health gesundheit sante salud hospital krankenhaus hopital city stadt ville ciudad parliament council bakery baeckerei boulangerie bicycle fahrrad velo forum wiki docs photo radio river mountain berge montagne "
    "kitchen family familie famille village theatre theater teatro poetry biology chemistry physics economy insurance railway eisenbahn reading writing letters northern southern weekly standard other there between things "
    "training building painting printing shipping housing planning cleaning cooking fishing hiking running cycling swimming teaching knitting farming banking engineering consulting academy campus institute studies station national "
    "regional international association foundation society community church museumshop market shop store house home office studio design group service solutions systems software support medical dental legal energy solar electric"
).split()


WEIGHTS = "weights__"
DIMS, SIZES = 32_768, (3, 4)


def host_of(url: str) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.expr(rf"coalesce(regexp_extract({url}, r'^(?s:.*?)://([^/?#]*)', 1), '')"))


def path_of(url: str) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.expr(rf"coalesce(regexp_extract({url}, r'^(?s:.*?)://[^/?#]*([^?#]*)', 1), '')")


def features(dims: int, sizes: tuple[int, ...]) -> str:
    """SQL over host and path: the distinct buckets of their n-grams, and the last bucket for the intercept."""
    parts = []
    for name in ("host", "path"):
        marked = f"concat('^', {name}, '$')"
        for n in sizes:
            grams = f"transform(sequence(1, greatest(char_length(t) - {n - 1}, 1)), i -> cast(pmod(xxhash64('{name}', substr(t, i, {n})), {dims}) as int))"
            parts.append(bound(marked, "t", grams))
    return f"concat(array_distinct(concat({', '.join(parts)})), array({dims}))"


def made_up(rng: random.Random) -> str:
    """A name of two to five syllables, each a consonant or two, a vowel or two and sometimes a consonant, or of 4 to 14 letters by their frequency in English."""
    if rng.random() < 0.5:
        return "".join(rng.choices("etaoinshrdlucmfwypvbgkjqxz", [127, 91, 82, 75, 70, 67, 63, 61, 60, 43, 40, 28, 28, 24, 24, 24, 22, 20, 19, 10, 15, 8, 2, 1, 1, 1], k=rng.randint(4, 14)))
    heads, vowels, tails = "b c d f g h k l m n p r s t v w br ch cl dr gr pl sch sh st th tr wh".split(), "a e i o u ai ea ie ou".split(), ["", "", "n", "r", "s", "t", "l", "nd", "ng"]
    return "".join(rng.choice(heads) * (rng.random() < 0.8) + rng.choice(vowels) + rng.choice(tails) for _ in range(rng.randint(2, 5)))


def labelled_table(rows: int = 12_000, unwanted: float = 0.4, seed: int = 3) -> list[tuple[str, str, bool]]:
    """A small labelled table (host, path, blocked): a share of the names hold an unwanted word, the others are ordinary words or made up.

    Either kind stands alone or is joined, with or without a hyphen, to a made-up name, an ordinary word or a number, and ends in a common domain; paths are ordinary
    words and say nothing about the label. Neither names nor paths are taken from the pages to be judged.
    """
    rng = random.Random(seed)
    out = []
    for _ in range(rows):
        bad = rng.random() < unwanted
        word = rng.choice(UNWANTED) if bad else rng.choice(ORDINARY) if rng.random() < 0.4 else made_up(rng)
        other = rng.choice([made_up(rng), made_up(rng), rng.choice(ORDINARY), str(rng.randint(1, 999))])
        name = rng.choice([word, f"{word}-{other}", f"{other}-{word}", f"{word}{other}", f"{other}{word}"])
        host = rng.choice(["", "", "www."]) + name + rng.choice([".com", ".net", ".org", ".info", ".de", ".fr", ".es", ".it", ".co.uk"])
        out.append((host, "/" + "/".join(rng.choice(ORDINARY) for _ in range(rng.randint(0, 3))), bad))
    return out


def train(labelled: DataFrame, dims: int = DIMS, sizes: tuple[int, ...] = SIZES, epochs: int = 300, rate: float = 0.3, decay: float = 1e-4) -> list[float]:
    """Weights of dims buckets and the intercept, by full-batch steps of falling size over a small labelled table.

    `labelled` (host, path, blocked) is bounded by its maker, thousands of rows; its features reach the driver, where the model is fitted. Both labels weigh the
    same. With one label or no rows all weights are zero except an intercept of -1, which allows everything.
    """
    rows = sorted((r["blocked"], r["f"]) for r in labelled.where("blocked is not null").select("blocked", F.expr(features(dims, sizes)).alias("f")).collect())
    y = np.array([r[0] for r in rows], np.float64)
    if not 0 < y.sum() < len(y):
        return [0.0] * dims + [-1.0]
    at, own = np.concatenate([r[1] for r in rows]), np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, squares = np.zeros(dims + 1), np.full(dims + 1, 1e-8)
    for _ in range(epochs):
        wrong = (1 / (1 + np.exp(-np.bincount(own, w[at], len(y)))) - y) * share
        slope = np.bincount(at, wrong[own], dims + 1) + decay * w
        squares += slope * slope
        w -= rate * slope / np.sqrt(squares)
    return np.round(w, 6).tolist()


def judge(pages: DataFrame, weights: list[float], dims: int = DIMS, sizes: tuple[int, ...] = SIZES, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """The columns of `pages` with host, path, rule, score and verdict (allow or block) of its url.

    A rule fits its host and all subdomains of it where the path starts with the rule's; of several the
    longest wins. Where none fits, rule is null and the model's probability, `score`, blocks from 0.5 on. A
    null url or one without `://` has empty host and path and is judged as such. Repeated rows are judged
    alike; an empty table gives no rows. Columns of these names in `pages` are replaced.
    """
    rows = pages.withColumns({"host": host_of("url"), "path": path_of("url")})
    rule, told = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, told = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(told)
    margin = f"aggregate({features(dims, sizes)}, 0d, (t, j) -> t + get({WEIGHTS}, j))"
    scored = f"1d / (1d + exp(-{margin}))"
    rows = rows.withColumn(WEIGHTS, constant_array(weights)).withColumn("score", F.expr(scored)).drop(WEIGHTS)
    return rows.withColumn("rule", rule).withColumn("verdict", F.coalesce(told, F.when(F.col("score") >= 0.5, "block").otherwise("allow")))
