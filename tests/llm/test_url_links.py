"""The same pages through the query and its SQL."""

import duckdb
import pandas as pd
import pytest

from tracebraid.llm import url_filter

BAD = "http://a.com/en/1"
LINK = f'<link rel="canonical" href="{BAD}">'
PAGES = [
    # (url, html, verdict)
    (BAD, None, "block"),
    ("http://c.de/1", f"<!-- {LINK} -->", "allow"),
    ("http://c.de/2", f"<!-- x -->\n{LINK}\n<!-- y -->", "block"),
    ("http://c.de/3", f"<!-- never closed {LINK}", "allow"),
    ("http://c.de/4", f'<link title="a > b" rel="canonical" href="{BAD}">', "block"),
    ("http://c.de/5", f"<link title='x > \"y' rel=canonical href={BAD}>", "block"),
    ("http://c.de/6", f'<link data-href="http://ok.de/" rel="canonical" href="{BAD}">', "block"),
    ("http://c.de/7", f'<link data-rel="canonical" rel="icon" href="{BAD}">', "allow"),
    ("http://c.de/8", f"<meta http-equiv=\"refresh\" content=\"0; url='{BAD}'\">", "block"),
    ("http://a.com/z/2", '<link rel=canonical href="../en/5">', "block"),
    ("http://c.de/y", f'<link rel="canonical" href="/out?u={BAD}">', "allow"),
    ("http://c.de/z", f'<link rel="alternate canonical" href="{BAD}">', "block"),
    ("http://c.de/0", f'<link rel="canonical-x" href="{BAD}">', "allow"),
    ("http://d.de/1", '<base href="http://a.com/en/"><link rel=canonical href="x">', "block"),
    ("http://d.de/2", '<BASE target="_top" HREF="//a.com/en/k/"><base href="http://ok.de/"><link rel=canonical href="../7">', "block"),
    ("http://d.de/3", '<!-- <base href="http://a.com/en/"> --><link rel=canonical href="x">', "allow"),
    ("http://d.de/4", '<base href=""><link rel=canonical href="/5">', "allow"),
    ("http://d.de/5", '<base href="mailto:x@y"><link rel=canonical href="/6">', "allow"),
    ("http://d.de/6", '<link rel=canonical href="mailto:x@y"><link rel=canonical href="?q#f">', "allow"),
    ("http://e.de/&", '<link rel=canonical href="http:&#47;&#x2F;a.com/en/1?x=1&amp;y=2">', "block"),
    ("http://f.de/a/b/c", '<link rel=canonical href="./../../.././d/.">', "allow"),
    ("http://f.de/d/", f"{LINK}", "block"),
    ("http://g.de/1", '<link rel="canonical" href="http://www.Example.com/en/77"><link rel=canonical href=http://a.com/en/others>', "allow"),
    ("nohost", LINK, "allow"),
    (None, LINK, "allow"),
    ("http://h.de/", "<link rel=canonical href='" + "x" * 30000 + "'>" + "<link a='" + "b" * 100000, "allow"),
    ("http://i.de/", "<link " + "a b=c " * 20000 + f"rel=canonical href={BAD}>", "block"),
]


@pytest.fixture(scope="module")
def pages():
    return pd.DataFrame([(i, u, h) for i, (u, h, _) in enumerate(PAGES)], columns=["page_id", "url", "html"])


def test_query_and_sql_agree_on_links(spark, pages):
    want = {i: v for i, (_, _, v) in enumerate(PAGES)}
    # The chain /a/b/c -> /d/ -> a.com ends at a blocked address.
    want[20] = "block"
    got = {r["page_id"]: r["verdict"] for r in url_filter.op8_url_filter(spark.createDataFrame(pages)).collect()}
    assert got == want
    con = duckdb.connect()
    con.register("pages", pages)
    rows = con.execute(f"SELECT page_id, verdict FROM ({url_filter.ORACLE})").fetchall()
    assert dict(rows) == want
