"""URL rules by hand, and what the tree makes of labelled templates."""

from narrascope.llm import url_tree as U


def test_rules_and_odd_urls(spark):
    urls = {1: "https://WWW.Example.com/en/5?x=/de/", 2: "http://example.com/en/5", 3: "http://a.example.com/en/", 4: "http://x.net/es/1#t",
            5: "http://x.net/es", 6: None, 7: "no scheme", 8: "://", 9: "http://com/x", 10: "http://telecom/x", 11: "http://x.com", 12: "a://b.net/fr/://c",
            13: "http://notexample.com/en/1", 14: "", 15: "http://X.com:80/a", 16: "http://" + "a" * 50_000 + ".com/" + "s/" * 3000}
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in urls.items()] + [(2, urls[2], "h", "r")], "page_id long, url string, host string, rule string")
    rows = U.op1_url_tree(df).collect()
    assert len(rows) == len(urls) + 1
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert got[1] == ("www.example.com", "/en/5", "www.example.com/en/", "allow")
    assert got[2] == ("example.com", "/en/5", "example.com/en/", "block") and got[3][2:] == ("example.com/en/", "block")
    assert got[4] == ("x.net", "/es/1", "net/es/", "block") and got[5][2] is None
    assert got[6][:3] == got[7][:3] == got[8][:3] == got[14][:3] == ("", "", None)
    assert got[9][2:] == ("com/", "allow") and got[10][2] is None and got[11] == ("x.com", "", None, got[11][3])
    assert got[12] == ("b.net", "/fr/:", "net/fr/", "block") or got[12][:2] == ("b.net", "/fr/://c")
    assert got[13][2:] == ("com/", "allow") and got[15][2] is None and got[16][2] == "com/"
    assert {r["verdict"] for r in rows} <= {"allow", "block"}
    assert U.op1_url_tree(df.limit(0)).count() == 0


def test_tree_generalises_merges_and_rejects(spark):
    rows = []
    for i in range(400):  # labelled spam below two alike branches, an unlike one, slugs
        rows += [f"http://h.net/es/{i}", f"http://h.net/fr/{i}", f"http://h.net/shop/item-{i}/buy", f"http://h.net/blog/slug{chr(97 + i % 26)}{chr(97 + i // 26)}"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r["page_id"]: r for r in U.op1_url_tree(df).collect()}
    assert {got[4 * i]["template"] for i in range(400)} == {got[4 * i + 1]["template"] for i in range(400)} == {"{*}/<n>"}
    assert got[0]["purity"] > 0.8 and got[2]["template"] == "shop/item-<n>/buy" and got[3]["template"] == "blog/*"


def test_branches_without_labels_are_merged_and_judged(spark):
    rows = []
    for i in range(400):  # no rule fits a .org host; on the .net host de is the twin of es and fr; shop is not
        rows += [f"http://h.org/es/{i}", f"http://h.org/fr/{i}", f"http://h.net/de/{i}", f"http://h.net/es/{i}", f"http://h.net/fr/{i}", f"http://n.org/x/y-{i}/z"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r["page_id"]: r for r in U.op1_url_tree(df).collect()}
    assert all(got[6 * i + k]["template"] == "{*}/<n>" for i in range(400) for k in range(5))
    assert got[2]["rule"] is None and got[2]["verdict"] == "block" and got[2]["purity"] > 0.99
    assert got[5]["template"] == "x/y-<n>/z"


def test_purity_falls_back_to_host_then_to_the_template_elsewhere_then_to_all(spark):
    rows = [("a", "t", "t", 10, 10), ("a", "u", "u", 0, 0), ("b", "t", "m", 0, 0), ("b", "w", "m", 0, 0), ("b", "v", "v", 0, 0), ("c", "w", "w", 10, 0)]
    merged = spark.createDataFrame(rows, "host string, template string, merged string, labelled long, blocked long")
    got = {(r["host"], r["merged"]): r["purity"] for r in U.purities(merged).collect()}
    r, a = 0.5, U.ALPHA
    there = (10 + a * r) / (10 + a)
    want = {("a", "t"): (10 + a * (10 + a * there) / (10 + a)) / (10 + a), ("a", "u"): (10 + a * r) / (10 + a),
            ("b", "m"): (10 + a * r) / (20 + a), ("b", "v"): r}
    assert all(abs(got[k] - v) < 1e-6 for k, v in want.items()) and got["c", "w"] < 0.1 and len(got) == 5


def test_deep_paths_are_whole(spark):
    deep = "http://h.net/" + "/".join("s" for _ in range(200))
    rows = [f"{deep}/es/{i}" for i in range(20)] + [f"{deep}/shop/{i}/buy" for i in range(20)]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    assert {r["template"].rsplit("s/", 1)[1] for r in U.op1_url_tree(df).collect()} == {"<n>", "shop/<n>/buy"}
