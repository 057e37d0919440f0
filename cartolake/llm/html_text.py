"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks with their words, linked words and the region they stand
in. Word counts and link densities of a block and its neighbours are columns; a decision tree,
trained once a session on a small labelled table of generated pages, tells main text from the
rest, as an expression over those columns. Pages are never shuffled.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolake.llm.common import table

#: Pages of the labelled table that the tree is trained on.
TRAIN_PAGES = 1000
DEPTH = 8

# fixed values: elements of HTML by their part in a page
BREAKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
REGIONS = frozenset("address article aside blockquote body center details dialog div dl fieldset figure footer form header main menu nav ol section table td ul".split())
UNSHOWN = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math select object canvas audio video head button".split())
SIDE_TAGS = frozenset("nav aside footer form menu dialog search".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words in class or id that mark what stands beside the main text, and what holds it.
SIDE_WORDS = frozenset("ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu submenu sidebar side rail footer foot copyright legal masthead topbar header toolbar breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr notice notices alert popup modal overlay dialog toast comment comments commentlist disqus reply replies respond discussion share sharing social follow related recommended recommendations similar more trending popular teaser teasers widget widgets newsletter subscribe subscription signup login register search form tags taglist toc skip hidden".split())
MAIN_WORDS = frozenset("article content main post entry story prose".split())
#: Words that often stand in notices; how many a block has is one of its figures.
NOTICE_WORDS = re.compile(r"\b(?:cookies?|consent|privacy|subscribe|newsletter|advertisement|sponsored|rights reserved|copyright|sign ?up|log ?in|share this|follow us|read more|related|comments?|reply|menu|search|terms)\b|©", re.IGNORECASE)

_TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*)([^>=]*+(?:=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>]*+)[^>=]*+)*+)(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.DOTALL)
_MARKS = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.IGNORECASE)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

BLOCK = "struct<text:string,words:int,linked:int,region:int,heading:int,notice:int,group_words:int,group_linked:int>"


def _region(name: str, attrs: str, above: int) -> int:
    """-1 beside the main text, 0 unknown, 1 in what a class names as main, 2 in a main element, 3 in an article; what is beside stays so."""
    if above < 0 or name in SIDE_TAGS and not (name == "form" and "aspnet" in attrs.lower()):
        return -1
    tokens: set[str] = set()
    role = ""
    for key, *values in _MARKS.findall(attrs) if attrs else ():
        key, value = key.lower(), "".join(values)
        if key in ("class", "id"):
            tokens.update(t.lower() for t in _TOKEN.findall(value))
        elif key == "role":
            role = value.strip().lower()
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return -1
    if role in SIDE_ROLES:
        return -1
    if name == "header" and above < 1 and not tokens & (MAIN_WORDS - {"main"}):
        return -1
    side = tokens & SIDE_WORDS
    if tokens & MAIN_WORDS or name == "header":  # an entry's header is in it, and a content-sidebar holds both
        side -= {"header", "sidebar", "side"}
    if tokens & {"has", "with", "no", "without"}:
        side -= {"header", "sidebar", "side", "nav", "footer", "banner"}
    if side and name not in ("body", "article", "main") and role not in ("main", "article"):
        return -1
    if name == "article" and side & {"comment", "comments", "reply", "teaser", "related", "ad", "promo"}:
        return -1
    if name == "article" or role == "article":
        return 3
    if name == "main" or role == "main":
        return max(above, 2)
    return max(above, 1) if tokens & MAIN_WORDS and name != "body" else above


def page_blocks(page: str) -> list[dict]:
    """The text blocks of a page in order: what stands between tags that break the flow, with white space as one blank.

    Scripts, styles, fields and comments have no text; tags without an end, or cut off, end with the page.
    """
    out: list[dict] = []
    parts: list[tuple[str, bool]] = []
    open_: list[tuple[str, int, int]] = []  # name, region, number of an open element
    region, group, groups, links, heading, at = 0, 0, 0, 0, 0, 0

    def close_block() -> None:
        if parts:
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                linked = sum(len(t.split()) for t, in_link in parts if in_link)
                words = text.count(" ") + 1
                out.append({"text": text, "words": words, "linked": min(linked, words), "region": region, "heading": heading, "notice": len(NOTICE_WORDS.findall(text)) if len(text) < 2000 else 0, "group": group})
            parts.clear()

    while True:
        tag = _TAG.search(page, at)
        if (raw := page[at : tag.start() if tag else len(page)]):
            parts.append((html.unescape(raw) if "&" in raw else raw, links > 0))
        if not tag:
            break
        at, name = tag.end(), (tag[2] or "").lower()
        if not name:
            continue
        if name in UNSHOWN and not tag[1]:
            if not tag[3].endswith("/") or name not in ("svg", "math"):
                end = re.compile(rf"</{name}\b[^>]*>?", re.IGNORECASE).search(page, at)
                if name == "head" and not end:  # a head without an end goes up to the body
                    end = re.compile(r"(?=<body\b)", re.IGNORECASE).search(page, at)
                at = end.end() if end else at if name in ("head", "button", "object") else len(page)
            if name in BREAKS or name in ("textarea", "select", "button", "iframe"):
                close_block()
            continue
        if name == "a":
            links = 0 if tag[1] else 1
        elif name == "br":
            parts.append((" ", links > 0))
        elif name in BREAKS:
            close_block()
            links = 0
            heading = int(name[0] == "h" and name[1:].isdigit()) if not tag[1] else 0
            if name in REGIONS:
                if tag[1]:
                    found = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name), None)
                    if found is not None:
                        del open_[found:]
                else:
                    if name == "main":  # never stands in these, so they were not closed
                        while open_ and open_[-1][0] in ("nav", "header", "footer", "aside"):
                            open_.pop()
                    groups += 1
                    open_.append((name, _region(name, tag[3], open_[-1][1] if open_ else 0), groups))
                region, group = (open_[-1][1], open_[-1][2]) if open_ else (0, 0)
    close_block()
    sums: dict[int, list[int]] = {}
    for b in out:
        s = sums.setdefault(b["group"], [0, 0])
        s[0] += b["words"]
        s[1] += b["linked"]
    for b in out:
        b["group_words"], b["group_linked"] = sums[b.pop("group")]
    return out


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("text", pa.string()), *[(n, pa.int32()) for n in ("words", "linked", "region", "heading", "notice", "group_words", "group_linked")]]))
    for b in batches:
        blocks = [page_blocks(x.as_py()) if x.is_valid else [] for x in b.column("html")]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(blocks, kind)], names=["id", "url", "blocks"])


#: What the tree sees of a block: its own words and links, those of the blocks before and after and of its element, and where it stands.
FEATURES = ("words", "density", "before_words", "before_density", "after_words", "after_density", "group_words", "group_density", "region", "below_top", "heading", "notice")


def _figures(blocks: Column) -> Column:
    """blocks with the figures of each in order of FEATURES."""
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    density = lambda b: b["linked"] / b["words"]
    top = F.array_max(F.transform(blocks, lambda b: b["region"]))

    def one(b: Column, i: Column) -> Column:
        before, after = F.when(i > 0, F.get(blocks, i - 1)), F.get(blocks, i + 1)
        values = [b["words"], density(b), before["words"], density(before), after["words"], density(after), b["group_words"], b["group_linked"] / b["group_words"], b["region"], top - b["region"], b["heading"], b["notice"] / b["words"]]
        return F.struct(b["text"].alias("text"), *[number(v).alias(n) for v, n in zip(values, FEATURES, strict=True)])

    return F.transform(blocks, one)


def blocks_with_figures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, blocks): the text blocks of each page in order, each with its text and FEATURES."""
    read = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = dict(read.dtypes)
    blocks = read.mapInArrow(_blocks_of, f"id {kinds['id']}, url {kinds['url']}, blocks array<{BLOCK}>")
    return blocks.select("id", "url", _figures(F.col("blocks")).alias("blocks"))


class _Writer:
    """Invented pages of several layouts, with the blocks that are their main text."""

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)
        self.main: list[str] = []

    def words(self, low: int, high: int) -> str:
        word = lambda: "".join(self.rng.choice("abcdefghiklmnoprstuvwyz") for _ in range(self.rng.randint(2, 9)))
        text = " ".join(word() for _ in range(self.rng.randint(low, high)))
        return text.capitalize() + self.rng.choice(["", ".", ".", "."])

    def kept(self, text: str) -> str:
        self.main.append(text)
        return text

    def links(self, low: int = 3, high: int = 9, item: str = "li") -> str:
        return " ".join(f'<{item}><a href="/{i}">{self.words(1, 4)}</a></{item}>' for i in range(self.rng.randint(low, high)))

    def notice(self) -> str:
        text = self.rng.choice(["We use cookies", "Subscribe to our newsletter", "© All rights reserved", "Advertisement", "Share this", "Log in to comment", "Read more", "Privacy and terms"])
        return f"{text} {self.words(0, 14)}"

    def body(self, marked: bool = False) -> str:
        """Main text: a heading, paragraphs of any length, lists and quotes; where an element marks it as such, notices and lists of links are part of it."""
        r = self.rng
        out = f"<h{(h := r.randint(1, 2))}>{self.kept(self.words(2, 12))}</h{h}>" if r.random() < 0.9 else ""
        for _ in range(r.choice([1, 2, 4, 8, 14])):
            kind = r.random()
            if kind < 0.7:
                a, b = self.words(*r.choice([(1, 3), (5, 20), (20, 60), (60, 160)])), self.words(2, 20)
                link = self.words(1, 3)
                text = f"{a} {link} {b}" if r.random() < 0.3 else a
                out += f"<p>{self.kept(text).replace(link, f'<a href=/x>{link}</a>', 1) if text != a else self.kept(a)}" + r.choice(["</p>", ""])
            elif kind < 0.8:
                out += f"<h3>{self.kept(self.words(1, 6))}</h3>"
            elif kind < 0.9:
                out += "<ul>" + "".join(f"<li>{self.kept(self.words(2, 18))}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
            elif marked and kind < 0.93:
                out += f"<p>{self.kept(self.notice().strip())}</p>"
            elif marked and kind < 0.95:
                out += "<ul>" + "".join(f'<li><a href="/z">{self.kept(self.words(1, 5))}</a></li>' for _ in range(r.randint(2, 5))) + "</ul>"
            elif kind < 0.97:
                out += f"<blockquote>{self.kept(self.words(8, 40))}</blockquote>"
            else:
                out += f'<p><a href="/y">{self.kept(self.words(2, 6))}</a></p>'
        return out

    def page(self) -> str:
        r, layout = self.rng, self.rng.random()
        nav = f"<nav><ul>{self.links()}</ul></nav>"
        foot = f"{self.notice()} {self.words(0, 12)}"
        lure = f'<div class="{r.choice(["ad", "promo", "cookie-notice", "newsletter"])}">{self.notice()}</div>'
        remarks = "".join(f"<p>{self.words(3, 40)}</p>" for _ in range(r.randint(1, 5)))
        if layout < 0.25:  # elements with meanings
            inner = self.body(True) + (f'<section class="comments">{remarks}</section>' if r.random() < 0.4 else "") + (lure if r.random() < 0.3 else "")
            text = f"<header><p>{self.words(1, 5)}</p>{nav}</header><main><article>{inner}</article><p>{self.words(1, 30)}</p></main><aside><p>{self.words(3, 40)}</p><ul>{self.links()}</ul></aside><footer>{foot}</footer>"
        elif layout < 0.45:  # an article, and plain elements around it
            text = f"{nav}{lure if r.random() < 0.6 else f'<div>{self.words(3, 60)}</div>'}<article>{self.body(True)}</article><div>{self.words(*r.choice([(2, 40), (60, 250)]))}</div><footer>{foot}</footer>"
        elif layout < 0.65:  # classes
            main = r.choice(["content", "post-body", "entry", "article-text", "story"])
            inner = self.body() + (f'<div class="share">{self.links(2, 4, "span")}</div>' if r.random() < 0.4 else "")
            text = f'<div class="header">{self.words(1, 6)}</div><ul id="menu">{self.links()}</ul><div class="{main}">{inner}</div><div>{self.words(1, 25)}</div><div class="sidebar"><p>{self.words(5, 50)}</p></div><div id="footer">{foot}</div>'
        elif layout < 0.73:  # paragraphs and lines of links side by side
            lines = lambda: "".join(f"<p>{self.links(2, 6, 'span')}</p>" for _ in range(r.randint(1, 3)))
            text = f"{lines()}{self.body()}{lines()}<p>{self.notice()}</p><p>{foot}</p>"
        elif layout < 0.85:  # nothing but text and links
            text = f"<div><ul>{self.links(3, 40)}</ul></div><div>{self.body()}</div><div><ul>{self.links(3, 40)}</ul></div><div>{self.notice()}</div><div>{foot}</div>"
        elif layout < 0.93:  # tables
            text = f"<table><tr><td>{self.links(4, 9, 'div')}</td><td>{self.body()}</td></tr><tr><td>{foot}</td></tr></table>"
        elif layout < 0.96:  # nothing but what stands beside a main text
            text = f"<header>{self.words(1, 6)}{nav}</header><form><p>{self.words(2, 20)}</p></form><aside>{self.words(3, 60)}</aside><footer>{foot}</footer>"
        else:  # a list of links alone
            text = f"<div><ul>{self.links(8, 30)}</ul></div><div>{self.notice()}</div>"
        return f"<html><head><title>{self.words(2, 8)}</title><style>p{{}}</style></head><body>{text}" + r.choice(["</body></html>", ""])


def labelled_pages(n: int, seed: int) -> list[tuple[int, str, list[str]]]:
    """n invented pages (page_id, html, main), the same for the same seed; main: the blocks of the main text."""
    out = []
    for i in range(n):
        w = _Writer(seed * 1_000_003 + i)
        page = w.page()
        out.append((i, page, list(w.main)))
    return out


#: A tree's node: (feature, threshold, at most, above), or the class of a leaf.
Tree = tuple | float
_TREES: dict[str, Tree] = {}


def _tree(node) -> Tree:
    if node.getClass().getSimpleName() == "LeafNode":
        return node.prediction()
    return node.split().featureIndex(), node.split().threshold(), _tree(node.leftChild()), _tree(node.rightChild())


def main_text_tree(spark: SparkSession, n_pages: int = TRAIN_PAGES, depth: int = DEPTH) -> Tree:
    """The decision tree of a session, trained on the blocks of n_pages labelled pages when first asked for."""
    key = f"{spark.sparkContext.applicationId} {n_pages} {depth}"
    if key not in _TREES:
        pages = spark.createDataFrame(labelled_pages(n_pages, 1), "page_id long, html string, main array<string>")
        blocks = blocks_with_figures(pages.withColumn("url", F.to_json("main")), "page_id")
        rows = blocks.select(F.from_json("url", "array<string>").alias("main"), F.explode("blocks").alias("b"))
        rows = rows.select("b.*", F.array_contains("main", F.col("b.text")).cast("double").alias("label"))
        fit = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", "label")
        model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=5, seed=1).fit(fit)
        _TREES[key] = _tree(model._call_java("rootNode"))
    return _TREES[key]


def is_main(block: Column, tree: Tree) -> Column:
    """Whether a block with figures is main text, as nested conditions."""
    if not isinstance(tree, tuple):
        return F.lit(tree > 0.5)
    feature, threshold, low, high = tree
    below, above = is_main(block, low), is_main(block, high)
    return F.when(block[FEATURES[feature]] <= threshold, below).otherwise(above)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every page: the blocks of its main text, two line feeds between.

    Character references are decoded and white space within a block is one blank. A null, empty or
    textless page has an empty text; repeated rows come again; ids and urls are passed on whatever
    they are; an empty table gives no rows; further columns are left out.
    """
    tree = main_text_tree(pages.sparkSession)
    blocks = blocks_with_figures(pages, id_col, url_col, html_col)
    texts = F.transform(F.filter("blocks", lambda b: is_main(b, tree)), lambda b: b["text"])
    out = blocks.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.array_join(texts, "\n\n").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


#: On these pages the main text is what the article element holds.
OP11_SQL = r"""
WITH articles AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS body FROM pages
), blocks AS (
  SELECT page_id, url, unnest(parts) AS part, unnest(range(len(parts))) AS pos
  FROM (SELECT page_id, url, regexp_split_to_array(regexp_replace(body, '<br>', ' ', 'g'), '</?(p|h1)>') AS parts FROM articles)
), texts AS (
  SELECT page_id, pos, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(part, '</?b>', '', 'g'),
           '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g')) AS t
  FROM blocks
), joined AS (
  SELECT page_id, string_agg(t, chr(10) || chr(10) ORDER BY pos) AS text FROM texts WHERE t <> '' GROUP BY page_id
)
SELECT p.page_id, p.url, coalesce(j.text, '') AS text, length(coalesce(j.text, '')) AS n_chars FROM pages p LEFT JOIN joined j USING (page_id)
"""
