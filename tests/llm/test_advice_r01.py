"""One small test for each finding of the first review: the whole job, where less was done before."""

from strandbook.llm import near_duplicates, personal_data, url_filters, warc_derivatives


def test_email_seeds_discover_tokens_with_an_at_sign(spark):
    letters = "abcdefghijklmnopqrst"
    rows = [(i, f"please write to ann.{a}@mail.example.com before noon") for i, a in enumerate(letters)]
    rows += [(100, "please write to john@localhost before noon"), (101, "please write to jane.doe@@corp before noon"), (102, "please write to @ before noon"), (103, "they met bob@home again"), (104, "please write to @@ a@ @b before noon")]
    found = {r["doc_id"]: r["spans"] for r in personal_data.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0] == "email:16:38"
    assert found[100] == "other:16:30" and found[101] == "other:16:30"
    assert found[102] == found[103] == found[104] == ""


def test_globs_search_the_path(spark):
    urls = ["http://x.net/casino/", "http://x.net/a/cheap-pills.html", "http://x.net/ca/sino", "http://spam.net/", "http://x.net/?casino", "http://x.com/fr/casino", "http://cas.net/ino", "http://x.net/a.org/"]
    got = [(r["rule"], r["verdict"]) for r in url_filters.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()]
    assert got == [(None, "block"), (None, "block"), (None, "allow"), (None, "block"), (None, "allow"), ("com/fr/", "allow"), (None, "allow"), (None, "allow")]


def test_conversions_lose_no_text_and_metadata_keep_headers(spark):
    pages = [
        ("a<noscript>b</noscript> <template>c", "ab c"), ("a<script>x</script y> b", "a b"), ("a<script>'<!--'</SCRIPT\n>b", "a b"), ("a<!-- <script> -->b", "ab"),
        ("a<style-guide>b", "ab"), ("a<style>b</script>c", "a"), ("a<script>b</scripts>c</script>d", "a d"), ("a<!-- b", "a"),
    ]
    responses = warc_derivatives.responses_of(spark.createDataFrame([(i, "http://a/", html) for i, (html, _) in enumerate(pages)], "page_id long, url string, html string"))
    rows = {(r["page_id"], r["type"]): r for r in warc_derivatives.derive(responses).collect()}
    assert [rows[i, "conversion"]["block"] for i in range(len(pages))] == [text for _, text in pages]
    sent = f"source-http: HTTP/1.1 200 OK\r\nsource-http: Content-Type: text/html; charset=utf-8\r\nsource-http: Content-Length: {len(pages[0][0])}\r\n"
    assert rows[0, "metadata"]["block"].endswith("\r\n" + sent) and sent in rows[0, "metadata"]["record"]


def test_repeated_ids_lose_no_clean_text(spark):
    one, two, other = (" ".join(f"{letter}{i}" for i in range(60)) for letter in "abc")
    near = one + " more"
    rows = [(1, one), (2, near), (2, two), (3, other), (3, two), (3, ""), (3, ""), (None, one)]
    kept = near_duplicates.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(0, one), (1, one), (2, two), (3, other), (3, "")])
