import html
import re
from collections import defaultdict

from pyspark.sql import functions as F
from tables import CLASHES

from tessella.llm.chat import rotate_perspectives
from tessella.llm.html_text import extract_pages, main_text

FOLDER = "/root/testdata/sf0.01"


def test_articles_of_the_pages(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    got = {r["page_id"]: r for r in extract_pages(pages).collect()}
    assert len(got) == pages.count()
    for page in pages.collect():
        article = re.search(r"<article>(.*)</article>", page["html"], re.S).group(1)
        parts = re.split(r"<p>|</p>|</h1>", article.replace("<br>", " "))
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in parts]
        want = "\n".join(b for b in blocks if b)
        assert got[page["page_id"]]["text"] == want
        assert got[page["page_id"]]["n_chars"] == len(want) and got[page["page_id"]]["url"] == page["url"]


def test_what_stands_beside_the_article():
    page = """<html><head><title>t</title><script>var a = "<p>no</p>";</script></head><body>
    <header><p>Top of the site</p></header><div id="cookie-notice"><p>We use cookies.</p></div>
    <div class="post"><h2>Head &amp; shoulders</h2><p>First,   with <b>bold</b>\n words.<p>Second, <span class=ad>buy</span>with <a href=x>link</a>.
    <ul><li>one<li>two</ul><blockquote>Said.</blockquote><table><tr><td>a<td>b</table></div>
    <aside>Side</aside><form><label>Name</label></form><div class="sidebar wide">Links</div>
    <section id=comments><p>Nice post, thanks to you all for it!</p></section><footer>&copy; us</footer></body></html>"""
    assert main_text(page).split("\n") == [
        "Head & shoulders", "First, with bold words.", "Second, with link.", "one", "two", "Said.", "a", "b"
    ]
    assert main_text("<main><header><h1>Title</h1></header><p>Text &#233;&lt;b&gt;</main><p>after</p>") == "Title\nText é<b>"


def test_names_inside_an_article_leave_it_to_the_ratios():
    long = "A whole sentence of the article, with commas, and a stop."
    page = f"""<article><header class="entry-header"><h1>Title</h1></header><div class="post-header"><h2>Part</h2></div>
    <p>{long}</p><p class="related-work">{long} Cited.</p><div class="share-buttons"><p>Tell friends</p></div>
    <div class="related-posts"><p><a href=x>{long}</a></p></div><p>One <span class="share-link">share</span>.</p>
    <section class="post-comments"><p>{long} I agree.</p></section><div class="related"><p>{long} Other.</p></div></article>"""
    want = ["Title", "Part", long, f"{long} Cited.", "One ."]
    assert main_text(page).split("\n") == want
    # without the ratios the buttons and the linked list would stay
    off = re.sub("share-buttons|related-posts", "plain", page)
    assert main_text(off) != main_text(page) and "Tell friends" in main_text(off)


def test_awkward_pages(spark):
    assert [main_text(p) for p in (None, "", "  ", "<p>", "<!-- only -->", "a < b")] == ["", "", "", "", "", "a < b"]
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    assert main_text(deep) == "deep text"
    assert main_text("<p>x " * 20000).count("\n") == 19999
    rows = [(1, "u", "<p>a, b.</p>"), (1, "u", "<p>a, b.</p>"), (None, None, None), (2, None, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {name: F.lit(-1) for name in [*CLASHES, "n_chars"]}
    )
    df = df.drop("text").withColumn("text", F.lit("x"))
    got = sorted(tuple(r) for r in extract_pages(df).where("page_id is not null").collect())
    assert [g[2:] for g in got if g[0] == 1] == [("a, b.", 5)] * 2
    assert extract_pages(df).where("page_id is null").first()["text"] == ""
    assert extract_pages(df.where("false")).count() == 0


def brute_chat(rows):
    dialogues = defaultdict(list)
    for conv, turn, who, text in rows:
        dialogues[conv].append((turn is not None, turn or 0, "unknown" if who is None else who, text or ""))
    out = {}
    for conv, turns in dialogues.items():
        for me in {t[2] for t in turns} - {"system"}:
            text, masks = "", []
            for _, _, who, said in sorted(turns):
                role = "system" if who == "system" else "assistant" if who == me else f"user name={who}"
                text += f"<|im_start|>{role}\n"
                start = len(text)
                text += f"{said}<|im_end|>\n"
                if who == me:
                    masks.append((start, len(text)))
            out[conv, me] = (text, masks, sum(b - a for a, b in masks), len(turns))
    return out


def got_chat(df):
    return {
        (r["conv_id"], r["perspective"]): (r["text"], [tuple(m) for m in r["masks"]], r["n_trained"], r["n_turns"])
        for r in df.collect()
    }


def test_perspectives_of_the_conversations(spark):
    df = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    assert got_chat(rotate_perspectives(df)) == brute_chat([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_chat_edges(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "ann", "Hi 😀"), (1, 2, "bob", None), (1, 2, "bob", None),
        (1, 3, None, "who am I?"), (1, None, "cyd", "before all"), (2, 0, "system", "alone"), (None, 0, "ann", ""),
        (3, 5, "ann", "tie"), (3, 5, "bob", "tie"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
        {name: F.lit(-1) for name in CLASHES if name not in ("text",)}
    ).drop("_text").withColumn("_pos", F.lit(1))
    assert got_chat(rotate_perspectives(df)) == brute_chat(rows)
    assert rotate_perspectives(df.where("false")).count() == 0


def test_long_dialogues_come_in_parts(spark):
    rows = [(1, i, "ab"[i % 2], f"t{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = rotate_perspectives(df, part_turns=16).orderBy("perspective", "part").collect()
    assert max(r["n_turns"] for r in parts) == 16 and len(parts) == 2 * 7
    whole = {me: "".join(r["text"] for r in parts if r["perspective"] == me) for me in "ab"}
    want = brute_chat(rows)
    assert all(whole[me] == want[1, me][0] for me in "ab")


def test_tags_with_an_open_quote_take_no_longer():
    page = "<p>Before it all.</p><div" + " " * 10_000 + '"><p>After it all, too.</p>'
    assert "Before it all." in main_text(page)
    assert main_text("<p>one</p>" + "<div x='" * 3000) is not None
