import random
import re

from ledgerlark.llm import urls
from ledgerlark.llm.queries import op4_urls

URLS = [
    None, "", "no scheme", "http://Example.NET/en/1?x#y", "https://sub.example.net/fr/2", "http://net", "http://a.net/", "http://badexample.net/en/3", "http://m.Example.com/de/4#top",
    "http://example.com/fr/5", "ftp://x.org/fr/6", "http://x.org?fr/", "http://x.org/fr", "x://y://z/p", "http://cheap-pills.shop/en/9", "http://éa.org/fr/\n7", "http://h/" + "p" * 20_000,
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits, key=lambda x: len(x[0]), default=(None, None)))


def test_rules_match_brute_force(spark, tmp_path):
    rows = [(i, u, "clash") for i, u in enumerate(URLS)] + [(3, URLS[3], None)]
    spark.createDataFrame(rows, "page_id bigint, url string, host string").write.parquet(f"{tmp_path}/pages.parquet")
    got = op4_urls(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = brute(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))


def fitted(spark, rows=None):
    return urls.train(spark.createDataFrame(urls.labelled_table() if rows is None else rows, "host string, path string, blocked boolean"))


def test_hosts_that_training_does_not_hold(spark):
    """Held-out hosts: other joined names, and ordinary ones strung by a rule that the labelled table doesn't have."""
    rng = random.Random(11)
    pairs = "th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sh ing ion ble ly wh".split()
    bad = [f"{p}{w}" for w in ("casino-win", "free-bets", "cheap-pills", "spam-farm", "adult-x", "ads-track", "poker77", "onlinegambling", "viagras", "pornhouse", "lotterywinner", "payday-loan") for p in ("", "www.", "m.", "blog.", "de.")]
    good = ["".join(rng.choices(pairs, k=4)) + rng.choice(["a", "o", "us"]) for _ in range(60)] + "townhall publisher orchestra teacher farmers-market biologists sailing cathedral bookshelf carpenter students weathermap".split()
    judged = {f"{h}.example.com" for h in bad + good}
    table = [r for r in urls.labelled_table() if r[0] not in judged]
    rows = [(i, f"http://{h}.example.com/en/{i}", i < len(bad)) for i, h in enumerate(bad + good)]
    told = urls.judge(spark.createDataFrame(rows, "page_id bigint, url string, weights boolean"), fitted(spark, table), rules=[]).collect()
    hit = sum(r.verdict == "block" and r.weights for r in told)
    false = sum(r.verdict == "block" and not r.weights for r in told)
    assert hit >= 0.9 * len(bad) and false <= 0.05 * len(good)


def test_without_rows_and_without_both_labels(spark):
    one = [("only.good", "/x", False)]
    for rows in ([], one):
        told = urls.judge(spark.createDataFrame([(1, "http://only.good/x"), (2, "http://casino.com/")], "page_id bigint, url string"), fitted(spark, rows)).collect()
        assert [r.verdict for r in told] == ["allow"] * 2
    assert urls.judge(spark.createDataFrame([], "page_id bigint, url string"), fitted(spark, one)).collect() == []
