from pathloom.llm import url_filter


def test_hosts_of_the_smallest_ranks_are_judged_as_well(spark):
    """Nine hops from the blocked page, each shared with forty other hosts: ranks below 1e-15."""
    rows = [("http://h0.com/de/", "")]
    for k in range(1, 10):
        link = f'<a href="http://h{k - 1}.com/x">'
        rows += [(f"http://h{k}.com/x", link)] + [(f"http://f{k}x{i}.com/y", link) for i in range(40)]
    rows.append(("http://alone.net/", ""))
    pages = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "page_id long, url string, html string")
    found = {r["host"]: r["verdict"] for r in url_filter.judge(pages).collect()}
    assert found.pop("alone.net") == "allow" and len(found) == len(rows) - 1
    assert {h for h, v in found.items() if v != "block"} == set()
