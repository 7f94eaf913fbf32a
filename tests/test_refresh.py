import json
from pathlib import Path

import pytest

from ledgerlark.functions import registry as R
from ledgerlark.operators import gates, normalize
from ledgerlark.plans import refresh
from ledgerlark.sources import files, site


def number(body):
    return f"{9 - sum(int(c) * (2 if k % 2 == 0 else 1) for k, c in enumerate(body)) % 9}{body}"


CORP = number("000012050002")


def csv(folder, kind, rows):
    """A bulk file of (key, organization, amount, agency, date)."""
    head = R.HEADERS[kind]
    names = [head[k] for k in ("corporate", "name", "date", "program", "amount", "agency", "key")] + [R.OPTIONAL["system"]]
    lines = [",".join(names)] + [f'{CORP},{org},{date},"計画, {key}",{amount},{agency},{key},gbiz' for key, org, amount, agency, date in rows]
    path = folder / f"{kind}.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def page(subsidies, procurements):
    row = lambda cells, tag="td": "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in cells) + "</tr>"
    rows = [["", name, "0", "0", "0", s, p, "0", "0"] for name, s, p in (("経済産業省 (小計)", subsidies, procurements), ("特許庁", 0, 0))]
    return f"<table id='corporateActivityNumbersTable'><thead>{row(files.DASHBOARD_HEADERS, 'th')}</thead><tbody>{''.join(map(row, rows))}</tbody></table>"


SUBSIDIES = [(f"s{k}", f"社{k}", 100 + k, "特許庁", "2026/04/01" if k % 2 else "") for k in range(6)]
PROCUREMENTS = [(f"p{k}", f"所{k}", f"-{k}", "NEDO", "2025-12-31") for k in range(4)]


@pytest.fixture(scope="module")
def site_root(spark, tmp_path_factory):
    """A root with an accepted first snapshot."""
    root, raw = tmp_path_factory.mktemp("root"), tmp_path_factory.mktemp("raw")
    imports = {k: normalize.import_kind(files.read_bulk_csv(spark, csv(raw, k, rows)), k, str(raw / f"import-{k}")) for k, rows in (("subsidy", SUBSIDIES), ("procurement", PROCUREMENTS))}
    n = {"subsidy": 6, "procurement": 4}
    told = {"record_count": 10, "imported": 10, "eligible": 10, "gap": 0, "dashboard": 12, "difference": 2, "imported_at": "2026-01-01", "status": "healthy"}
    for k, count in n.items():
        told |= {f"imported_{k}": count, f"eligible_{k}": count, f"total_{k}": count, f"bytes_{k}": 9, f"dashboard_{k}": count + 1, f"difference_{k}": 1, f"gap_{k}": 1}
    source = spark.read.schema(refresh.SOURCE).json(spark.sparkContext.parallelize([json.dumps(told)])).withColumn("rules_sha256", gates.rules_hash())
    snapshots = {"csvRetrievedAt": "t"} | {k: {"sha256": "0" * 64, "bytes": 9, "filename": "f"} for k in R.STAGES}
    refresh.accept(spark, normalize.union_of(imports).records, source, str(root), "0", "2026-01-01T00:00:00Z", "a" * 40, snapshots)
    return root


def run(spark, root, folder, version, subsidies=SUBSIDIES, procurements=PROCUREMENTS, board=(7, 5)):
    paths = {"subsidy": csv(folder, "subsidy", subsidies), "procurement": csv(folder, "procurement", procurements)}
    pages = spark.createDataFrame([(page(*board),)], "html string")
    return refresh.refresh(spark, paths, pages, "html", str(root), version, "2026-02-01T00:00:00Z", "b" * 40)


def test_a_good_snapshot_replaces_the_old_one_and_a_refused_one_does_not(spark, site_root, tmp_path):
    done = run(spark, site_root, tmp_path, "1", [*SUBSIDIES[:5], ("s5", "社5", 999, "特許庁", "2026/04/01"), ("s6", "社6", 1, "特許庁", "")])
    assert done.published and done.message == "11 records", done
    assert site.current(spark, f"{site_root}/site").endswith("v=1") and site.current(spark, f"{site_root}/data").endswith("v=1")
    release = json.loads(Path(done.path, "release.json").read_text())
    assert release["recordCount"] == 11 and release["sourceSnapshots"]["gbiz"]["subsidy"]["bytes"] == (tmp_path / "subsidy.csv").stat().st_size
    [change] = [json.loads(x) for p in (site_root / "audit" / "v=1" / "corrections").glob("part-*.json") for x in p.read_text().splitlines()]
    assert change["changedFields"] == ["amount", "amountRaw"] and (change["before"]["amount"], change["after"]["amount"]) == (105, 999)
    now = [*SUBSIDIES[:5], ("s5", "社5", 999, "特許庁", "2026/04/01"), ("s6", "社6", 1, "特許庁", "")]
    bad = {
        "missing": dict(subsidies=now[1:]), "limit": dict(subsidies=[("s0", "他社", 5, "特許庁", ""), ("s1", "別社", 5, "特許庁", ""), *now[2:]]), "suspicious": dict(subsidies=[*now, ("s9", "社", 1, "NEDO支部", "")]),
        "without a key": dict(subsidies=[*now, ("", "社", 1, "NEDO", "")]), "gap to the dashboard grew": dict(subsidies=now, board=(20, 5)), "more eligible rows": dict(subsidies=now, board=(6, 5)), "repeated id": dict(subsidies=[*now, now[0]]), "another number": dict(subsidies=[*now, ("x", "a,b", 1, "NEDO", "")]),
    }
    for k, (message, change) in enumerate(bad.items()):
        done = run(spark, site_root, tmp_path, f"bad{k}", **change)
        told = json.loads((site_root / "audit" / f"v=bad{k}" / "failure.json").read_text())
        assert not done.published and (message in done.message or message == "without a key") and told["message"] == done.message, (message, done)
        assert site.current(spark, f"{site_root}/site").endswith("v=1") and site.current(spark, f"{site_root}/data").endswith("v=1")
