"""Main text loses nothing but template: blocks that only some pages of a host hold."""

from pyspark.sql import functions as F

from touchline.llm import wrappers


def _extract(spark, htmls):
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    return {r.page_id: r.text.split("\n") for r in wrappers.extract(pages).collect()}


def test_labelled_blocks_of_some_pages_stay(spark):
    page = "<body><article><h1>Title {i}</h1><div class=k9>Always the same line</div>{lead}<p>Body number {i} of this host</p></article></body>"
    sampled = {r.id for r in spark.range(40).orderBy(F.xxhash64("id"), "id").limit(wrappers.SAMPLE_PAGES).collect()}
    leads = ["Lead of the copies" if i in sampled else f"Lead number {i}" for i in range(40)]
    got = _extract(spark, [page.format(i=i, lead=f"<p class=lead>{x}</p>") for i, x in enumerate(leads)])
    assert all(got[i] == [f"Title {i}", leads[i], f"Body number {i} of this host"] for i in range(40))


def test_template_needs_its_own_text():
    import json

    page = "<body><article><h1>T {i}</h1><div class=k9>{k}</div><p>Body number {i}</p></article></body>"
    wrapper = json.dumps(wrappers.induce([page.format(i=i, k="Always the same line") for i in range(5)]))
    assert wrappers.main_text(page.format(i=7, k="Always the same line"), wrapper) == "T 7\nBody number 7"
    assert wrappers.main_text(page.format(i=8, k="A line of this page"), wrapper) == "T 8\nA line of this page\nBody number 8"


def test_text_beside_the_longest_element_stays(spark):
    body = "words of the body number {i} " * 30
    titled = [f"<body><article><h1>Title {i}</h1><div class=body>{body.format(i=i)}</div></article></body>" for i in range(12)]
    got = _extract(spark, titled)
    assert all(got[i] == [f"Title {i}", " ".join(body.format(i=i).split())] for i in range(12))
    page = "<body><div class=top>Name of the site</div><ul><li><a href=1>one {i}</a><li><a href=2>two {i}</a></ul><h1>Title {i}</h1>{more}<div class=c><p>{body}</p></div><div>Fixed line</div>Seen by <b>reader {i}</b><div>Fixed line</div></body>"
    beside = [page.format(i=i, body=body.format(i=i), more=f"<p>Standfirst {i}</p>" if i == 3 else "") for i in range(12)]
    got = _extract(spark, beside)
    assert all(got[i] == [f"Title {i}", *([f"Standfirst {i}"] if i == 3 else []), " ".join(body.format(i=i).split()), f"Seen by reader {i}"] for i in range(12))


def test_pages_that_fit_no_wrapper_keep_all_articles():
    html = "<body><div>x</div><main><h1>Both</h1><article><p>one</p></article></main><div><article><p>two</p></article></div><article><p>three</p></article></body>"
    assert wrappers.main_text(html) == "Both\none\ntwo\nthree"


def test_path_is_found_on_all_pages(spark):
    """What a handful of pages show does not decide where the text of a host stands."""
    sampled = {r.id for r in spark.range(40).orderBy(F.xxhash64("id"), "id").limit(wrappers.SAMPLE_PAGES).collect()}
    story = "words of the story number {i} " * 20
    htmls = [f"<body><div class=top>Name of the site</div><div class=story>{'Soon' if i in sampled else story.format(i=i)}</div>{f'<div class=live>Live words {i}</div>' if i in sampled else ''}</body>" for i in range(40)]
    got = _extract(spark, htmls)
    assert all(got[i] == (["Soon", f"Live words {i}"] if i in sampled else [story.format(i=i).strip()]) for i in range(40))


def test_paths_of_a_host_are_those_of_its_pages_in_memory(spark):
    """Also where they are deeper than a block of levels, with text at each of them."""
    from touchline.llm.staging import Stage

    deep = lambda i: "".join(f"<div class=d{k}>{'a line ' + str(i * k) if k % 50 == 0 else ''}" for k in range(3 * wrappers.LEVELS)) + f"text number {i} " * 200
    flat = lambda i: f"<body><div class=a>one line</div><div class=b{i % 2}><section><p>text {i}</p></section></div></body>"
    sites = {"deep": [deep(i) for i in range(6)], "flat": [flat(i) for i in range(9)], "same": ["<body><p>x</p></body>"] * 4, "one": [flat(1)]}
    pages = spark.createDataFrame([(i, f"http://{h}/{i}", p) for h, site in sites.items() for i, p in enumerate(site)], "page_id long, url string, html string")
    paths = {r.host: r.path for r in wrappers.host_paths(pages.repartition(5), Stage(spark)).collect()}
    assert paths == {h: path for h, site in sites.items() if (path := wrappers.content_path([wrappers.parse(p) for p in site]))}
    assert len(paths["deep"]) == 3 * wrappers.LEVELS and paths["flat"] == ["body"]
