import html as html_module
import random
import re
import urllib.parse
import zlib

from curio.llm import sharding, toxicity, url_filter
from curio.llm.queries import QUERIES, URL_RULES

SF, SF1, SF10 = (f"/root/testdata/sf{x}" for x in ("0.001", "0.01", "0.1"))


def rule_of(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fit = [r for r in URL_RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fit, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


def test_url_query(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF1}/pages.parquet").collect()}
    for r in QUERIES["op6_url_filter"](spark, SF1).collect():
        host, path, rule, verdict = rule_of(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or "allow")


def test_aliases(spark):
    link = '<link rel="canonical" href="%s">'
    pages = [(1, "http://a.org/x", link % "https://b.net/es/1"), (2, "https://www.a.org/x/#f", None), (3, "https://a.org/x?utm_source=q", ""),
             (4, "http://c.org/1", "<LINK href='//d.org/2' rel='canonical'>"), (5, "http://d.org/2", link % "http://e.net/fr/9"),
             (6, "http://d.org/2", link % "https://ok.com/"), (7, "http://f.org/", '<meta http-equiv="refresh" content="0; url=/to">'),
             (8, "http://f.org/to", link % "https://z.net/fr/"), (9, None, None), (10, "no scheme", "x"), (11, "http://clean.org/", None),
             (12, "HTTP://WWW.Example.COM/en/1", None), (12, "http://x.Example.com/en/1", None)]
    out = url_filter.judge(spark.createDataFrame([(*p, "v") for p in pages], "page_id long, url string, html string, verdict string"), URL_RULES)
    got = sorted((r.page_id, r.verdict) for r in out.collect())
    assert got == [(1, "block"), (2, "block"), (3, "block"), (4, "allow"), (5, "allow"), (6, "allow"), (7, "block"), (8, "block"),
                   (9, "allow"), (10, "allow"), (11, "allow"), (12, "allow"), (12, "block")]
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string"), URL_RULES).count() == 0


def key_of(url):
    host, path, *_ = rule_of(url)
    if not url or "://" not in url:
        return None
    host = re.sub(r"^(?:www|m)\.", "", re.sub(r":(?:80|443)$", "", host))
    query = re.search(r"://[^?#]*(\?[^#]*)", url)
    return host + path.rstrip("/") + re.sub(r"^&", "?", re.sub(url_filter.TRACKING, "", query.group(1) if query else ""))


def test_aliases_against_brute_force(spark):
    rng = random.Random(11)
    hosts = ["@a.org", "www.@a.org", "@b.net", "example.com", "www.example.com", "m.@c.io:443", "@d.io", "@d.io"]
    paths = ["", "/", "/es/1", "/fr/x/", "/en/p.html", "/k/l/m", "/k/l/n?id=3&b=4", "/k?utm_source=z&id=1", "/q#f"]
    links = ["n?id=3&amp;b=4", "?id=1", "../x", "./m", "../../../es/1", "/k/./l/../l/m", "//@b.net/es/1", "m", "#top", "mailto:x-y.z", "HTTPS://@d.io/q",
             "https://@b.net/fr/x", "/en/p.html", "..", "x/../m", "?id=3&#38;b=4", "p?to=http://@b.net/es/1"]
    forms = ['<link rel="canonical" href="%s">', "<LINK href='%s' rel=canonical>", '<meta http-equiv="refresh" content="0; url=%s">']
    pages = []
    for i in range(400):                    # four pages to a group of hosts, so that verdicts differ between classes
        html = " ".join(rng.choice(forms) % rng.choice(links) for _ in range(rng.choice([0, 0, 0, 1, 2])))
        url = rng.choice(["http", "https"]) + "://" + rng.choice(hosts) + rng.choice(paths) + rng.choice(["", "", f"&v={i}"])
        pages.append((i, *(x.replace("@", f"g{i // 4}-") for x in (url, html))))
    root, said = {}, {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    targets = []
    for _, url, page in pages:
        for m in re.finditer(r"""(?:href=|url=)["']?([^"'\s>]+)""", page):
            target = urllib.parse.urljoin(url, html_module.unescape(m.group(1)))
            targets.append(target)
            if key_of(target) is not None:
                root[find(key_of(url))] = find(key_of(target))
    for url in [u for _, u, _ in pages] + targets:
        if key_of(url) is not None and rule_of(url)[3]:
            said.setdefault(find(key_of(url)), set()).add(rule_of(url)[3])
    exp = {}
    for i, url, _ in pages:
        of_class = said.get(find(key_of(url)), set())
        exp[i] = rule_of(url)[3] or ("block" if of_class == {"block"} else "allow")
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES).collect()}
    assert got == exp
    assert any(exp[i] == "block" and rule_of(url)[3] is None for i, url, _ in pages)


def shards(rows, n):
    rows = sorted(rows)
    total, before, out = sum(r[2] for r in rows), 0, []
    for i, c, s in rows:
        out.append((i, s, c, min(n - 1, (2 * before + s) * n // (2 * total))))
        before += s
    return out


def test_sharding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = [(r.doc_id, zlib.crc32(r.text.encode()), len(r.text.encode()) + 8) for r in docs]
    out = QUERIES["op5_sharding"](spark, SF).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32, r.shard) for r in out) == sorted(shards(rows, 24))
    for s in range(24):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_sharding_edges(spark, tmp_path):
    df = spark.createDataFrame([(None, None, 1), (None, "", 1), (2, "é" * 999, 1)] + [(7, "same", 1)] * 300, "doc_id long, text string, shard int")
    out = sharding.assign(df.repartition(5), 4).collect()
    assert len(out) == 303 and {r["size"] for r in out} == {8, 12, 2006}
    for s in range(4):
        mine = [r for r in out if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
    assert sharding.assign(df.limit(0), 4).count() == 0
    sharding.write_shards(df, str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 303


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF10}/labels.parquet").collect()}
    out = QUERIES["op10_toxicity"](spark, SF10).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [(r.score, labels[r.doc_id]) for r in out if r.held_out and r.doc_id in labels]
    toxic, clean = [s for s, t in held if t], [s for s, t in held if not t]
    auc = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert auc > 0.9


def test_grammar():
    lexicon, machine = toxicity.Lexicon({"idiot": 4.0, "scum*": 3.0}), toxicity.grammar()
    score = lambda t: sum(toxicity.clause_scores(t, lexicon, machine))
    assert score("You are an idiot.") > score("An idiot.") > score("He said an idiot.") > 0
    assert score("not an idiot.") < score("an idiot.") and score("never. an idiot.") == score("an idiot.")
    assert score("scumbag!") == 3.0 and score("I will kill you.") > score("The kill.") == 0
    assert score("") == 0 == score("clean words only") and len(toxicity.clause_scores("idiot. idiot; idiot", lexicon, machine)) == 3


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(None, None, 1.0), (1, "", 1.0), (1, "", 1.0), (2, "kill you " * 5000, 1.0)], "doc_id long, text string, score double")
    model = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    rows = toxicity.score(docs, model, ["doc_id"]).collect()
    assert len(rows) == 4 and max(r.score for r in rows) > 0.9 and min(r.score for r in rows) < 0.3
    assert toxicity.score(docs.limit(0), model, ["doc_id"]).count() == 0
