import xxhash

from motiflake.llm import urls

URLS = [
    None, "", "no scheme", "http://", "HTTP://EXAMPLE.com/en/7817?x#y", "https://a.b.example.com/en/8", "http://example.net/de/81",
    "http://example.net/de/7", "http://x.org/es/", "http://xorg/es/", "http://org/es/?q", "http://notexample.com/en/7", "x://a://b/en/",
    "http://www.casino-win.example.com/de/1", "http://casino-win.example.com/en/7", "http://com/en/", "http://com/en", "http://h\u00c9.com/en/\u00e9",
    "http://user@host.net:80/de/1", "http://a..net/de/", "http://example.com#/en/7", "http://free-bets.example.com", "http://" + "a." * 3000 + "com/en/",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = lambda h: host == h or host.endswith("." + h)
    best = None
    for verdict, rule in urls.RULES:
        h, p = rule.split("/", 1)
        if fits(h) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    if best:
        return host, path, best[1], best[0]
    return host, path, None, "block" if host and any(map(fits, urls.BLOCKED_HOSTS)) else "allow"


def pages(spark):
    return spark.createDataFrame([(i, u, "host") for i, u in enumerate(URLS)], "page_id long, url string, host string")


def test_against_brute_force(spark):
    got = urls.judge(pages(spark)).collect()
    assert len(got) == len(URLS)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(URLS[r["page_id"]])


def test_joined_form_agrees(spark):
    rules = spark.createDataFrame(list(urls.RULES), "verdict string, rule string")
    hosts = spark.createDataFrame([(h,) for h in urls.BLOCKED_HOSTS], "host string")
    own = sorted(map(str, urls.judge(pages(spark)).collect()))
    assert sorted(map(str, urls.judge_joined(pages(spark), rules, hosts).collect())) == own
    assert "block" in str(own) and "casino-win" in str(own)
    none = urls.judge_joined(pages(spark), rules.limit(0), hosts.limit(0))
    assert none.count() == len(URLS) and {r["verdict"] for r in none.collect()} == {"allow"}


def test_hosts_made_by_rule():
    assert len(set(urls.BLOCKED_HOSTS)) == 2 * len(urls.TRADES) * len(urls.LURES) * len(urls.ENDINGS)
    assert {"casino-win.example.com", "cheap-pills.example.com", "free-bets.example.com"} <= set(urls.BLOCKED_HOSTS)


def test_collisions_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda raw: len(raw) % 3)
    rules = [("block", f"h{i}.com/x/") for i in range(40)]
    urls.write(rules, ["a.com", "b.com"], str(tmp_path / "d"))
    digest = urls.read(str(tmp_path / "d"))
    found = digest.find([r for _, r in rules] + ["h99.com/x/", "#a.com", "a.com"])
    assert all(digest.string(int(p)) == r for p, (_, r) in zip(found, rules))
    assert found[40] == -1 and digest.kinds[found[41]] == 2 and found[42] == -1


def test_no_rules_and_empty_table(spark):
    assert {r["verdict"] for r in urls.judge(pages(spark), [], []).collect()} == {"allow"}
    assert urls.judge(pages(spark).limit(0)).count() == 0
