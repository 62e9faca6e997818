import hashlib
import re
from dataclasses import replace

from faultlens.llm import blob_secrets
from tests.llm import samples

ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def brute(text):
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(ASSIGN, text) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


TEXTS = [
    'Password = "abc" secret=\'longenough1\' API_KEY:x token:   "ab.cd-ef=="',
    "paſſword: 12345678 toKen: 12345678 apiKey=12345678",
    "AKIAABCDEFGHIJKL AKIA AKIAAKIAAKIAAKIAX akiaabcdefghijkl",
    "token=0123456789abcdef0123456789abcdef0 " + "f" * 31 + " " + "F" * 40 + " é" + "a" * 100,
    "-----BEGIN RSA PRIVATE KEY----- eyJhbGciOi1.eyJzdWIiOiIx.c2lnbmF0dXJl",
    "secret" + " " * 5000,
    "token" * 3000 + ":x",
    "eyJ" * 5000,
    "\U0001f600 token=12345678",
    "",
    None,
]


def test_query(spark):
    texts = TEXTS + [TEXTS[0]] * 5
    rows = {r.doc_id: r for r in blob_secrets.document_secrets(samples.plain(spark, [t or "" for t in texts])).collect()}
    for i, text in enumerate(texts):
        base, row = brute(text or ""), rows[i]
        assert row.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), text
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex")]
        assert set(base) <= set(row.spans.split(","))
    assert "private_key:0:31" in rows[4].spans and "web_token" in rows[4].spans


def test_only_unseen_pairs_are_scanned(spark, tmp_path):
    ledger = f"{tmp_path}/ledger"
    rules = blob_secrets.RULES[:2]

    def versions(*texts):
        return spark.createDataFrame(list(enumerate(texts)), "path LONG, content STRING")

    first = blob_secrets.scan(versions("token=12345678", "plain", "plain"), "path", "content", ledger, rules)
    assert {r.path: [f.kind for f in r.findings] for r in first.collect()} == {0: ["assign"], 1: [], 2: []}
    assert spark.read.parquet(ledger).count() == 2 * len(rules)

    # A known blob at another path costs nothing; a new one is scanned with all rules.
    history = versions("plain", "token=12345678", "AKIAABCDEFGHIJKL")
    again = blob_secrets.scan(history, "path", "content", ledger, rules)
    assert {r.path: [f.kind for f in r.findings] for r in again.collect()} == {0: [], 1: ["assign"], 2: ["access"]}
    assert spark.read.parquet(ledger).count() == 3 * len(rules)

    # A new version of one rule reads all blobs, for that rule alone, and replaces its findings.
    newer = (replace(rules[0], version=2, keep=lambda m: len(m[1]) >= 20), rules[1])
    shared = history.selectExpr("path AS p", "content AS c")
    fresh = blob_secrets.unseen(
        shared.selectExpr("p AS path", "sha2(c, 256) AS blob", "c AS content"), blob_secrets.read_ledger(spark, ledger), newer
    )
    assert {tuple(r.missing) for r in fresh.collect()} == {("assign@2",)}
    last = blob_secrets.scan(history, "path", "content", ledger, newer)
    assert {r.path: [f.kind for f in r.findings] for r in last.collect()} == {0: [], 1: [], 2: ["access"]}


def test_awkward_rows(spark):
    docs = samples.awkward(spark)
    rows = blob_secrets.document_secrets(docs).collect()
    given = samples.awkward_rows()
    assert len(rows) == len(given)
    want = sorted((i is None, i or 0, hashlib.sha256(",".join(brute(t or "")).encode()).hexdigest()) for i, t, *_ in given)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.base_sha256) for r in rows) == want


def test_empty(spark):
    assert blob_secrets.document_secrets(samples.empty(spark)).count() == 0


def test_equal_rows_are_scanned_once(spark, tmp_path):
    """A row repeated 500 times leaves a ledger row for each rule, and a finding for each of its rows."""
    df = spark.createDataFrame([(1, TEXTS[2])] * 500 + [(2, "nothing")], "doc_id LONG, text STRING").coalesce(1)
    path = str(tmp_path / "ledger")
    rows = blob_secrets.document_secrets(df, ledger_path=path).collect()
    assert len(rows) == 501 and len({r.spans for r in rows if r.doc_id == 1}) == 1
    ledger = blob_secrets.read_ledger(spark, path)
    assert ledger.count() == ledger.select("blob", "rule", "version").distinct().count() == 2 * len(blob_secrets.RULES)
    again = blob_secrets.document_secrets(df, ledger_path=path).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows)) and blob_secrets.read_ledger(spark, path).count() == 2 * len(blob_secrets.RULES)
