"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element is a binary variable: content or not.  Its own potential is log-linear in its name, the words of its
class, id and role, its amount of text (its own and with all below it), its share of linked text, whether it is one of several
signed siblings that look alike and end the text (as reader comments do), whether it lies outside the page's article landmark,
and whether the page is bare, without links, names or landmarks; potentials on parent and child couple them.  Sum-product messages go up and down the tree and give exact content marginals in two passes.
The weights are trained by gradient ascent on the likelihood of labelled pages, for which the same messages give the
expected counts.

Labelled pages: a bounded sample of the table's own pages that mark their article with HTML landmarks, labelled by those
landmarks, and ``LABELLED``, hand-labelled layouts that the sample may lack, such as pages without any landmark.  Every page is
extracted whole, in the task that reads it; nothing is shuffled.

Defined cases: null and empty pages give empty text; broken and cut markup is read as far as it goes, an unfinished tag
at the end is dropped; text outside any element belongs to the root, which is content where the page is plain text.  Scripts,
styles and form values are never text; formulas and the fallback text of embedded objects are.  Very long and deeply nested
pages are read whole; rows that repeat are extracted each; an empty table gives an empty result; columns besides
page_id, url and html are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import dom
from tidemark.llm.shared import table, text_chunks

SAMPLE_PAGES, MAX_NODES = 24, 400

# Words in class, id and role that hint at either side.
BOILERPLATE = frozenset(
    "ad ads advert advertisement adverts aside banner breadcrumb breadcrumbs buttons comment comments consent cookie cookies disqus dialog "
    "footer form header login masthead menu menubar modal nav navbar navigation newsletter notice pagination popup promo promoted related "
    "reply replies search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget".split()
)
CONTENT = frozenset("article articlebody body content entry main page post story text".split())
#: Elements whose role is plain from the name; others fall under "other".
NAMED = frozenset("a article aside b blockquote body button div dd dl dt em fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header html i img input label li main nav ol p pre section span strong table td th tr ul".split())
#: Elements and names of which show that a page has other parts than its text.
SIDE = frozenset("a nav footer aside header form button iframe dialog menu".split())
#: Names that tell where on the screen a part stands.
PLACE = frozenset("left rail right side".split())
#: Elements of which several with one class may be comments; items, rows, terms and quotes are parts of a text.
ALIKE = frozenset("div section article".split())
#: Elements that may hold the name of a writer or a time, and the longest such text.
SIGNING, SIGNED_BY = frozenset("a b cite em i small span strong time".split()), 40
#: Elements that show, where they follow, that the text goes on.
GOES_ON = frozenset("p h1 h2 h3 blockquote pre table ul ol".split())
_KIND = re.compile(r"""(?:^|\s)class\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
NOT_CONTENT = frozenset("nav footer aside header form head script style button noscript template iframe title dialog menu".split())

LABELLED = [
    '<body><header><h1>Site</h1><nav class="menu"><a href="/">Home</a><a href="/n">News</a></nav></header><div id="wrap"><div class="content" data-content="1"><h1>Title of it</h1><p>A first paragraph, with some words, and more of them to read here.</p><p>Second paragraph of the story, longer than a menu entry.</p></div><div class="sidebar"><h3>Related</h3><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></div></div><div class="footer">Copyright by someone</div></body>',
    '<body><div class="cookie-notice"><p>We use cookies to make this site better, please accept them all.</p><button>Accept</button></div><main data-content="1"><article><h1>Heading words</h1><p>Text of the article, in full sentences, with <a href="/x">one link</a> inside it.</p><ul><li>First point made in the text</li><li>Second point made in the text</li></ul><form data-content="0"><label>Your name</label><input name="n"></form><blockquote>Quoted words of another writer.</blockquote></article></main><section class="comments"><h2>Comments</h2><div class="comment"><p>I liked this article a lot, thank you for writing it.</p></div><div class="comment"><p>I did not, there are words missing in it, sadly.</p></div></section></body>',
    '<body><div id="nav"><ul><li><a href="/1">A</a></li><li><a href="/2">B</a></li></ul></div><div class="ad">Buy this thing now, it is cheap and good.</div><article data-content="1"><header data-content="0"><p>By A. Writer, today</p></header><h2>Name of the piece</h2><p>Words, words and words, all of which are the article itself.</p><aside data-content="0"><p>Read more of our other stories, they are good.</p></aside><p>Closing words of the article, in one more paragraph.</p><footer data-content="0"><p>Filed under things</p></footer></article><footer><p>All rights reserved by the owner.</p></footer></body>',
    '<body><div class="banner">Sale ends soon, all must go</div><div class="post" data-content="1"><h1>Post</h1><div class="entry"><p>Body text of the post is here, for reading.</p><pre>code = 1</pre><table><tr><td>Cell one</td><td>Cell two</td></tr></table></div><div class="share" data-content="0"><a href="/t">Tell</a> <a href="/f">Send</a></div></div><div class="related"><p>You may also like these posts by others.</p></div><div class="newsletter"><form><p>Sign up for letters from us, every week.</p></form></div></body>',
    '<body><nav><a href="/">Start</a></nav><article data-content="1"><h1>H</h1><p>One.</p><p>Two words.</p><p><b>Bold opening of a paragraph</b> and then the rest of it.</p><section><h2>Part</h2><p>More text in the part.</p></section><div class="ad" data-content="0">An advert in the middle of it all.</div><p>The end.</p></article><div class="comments"><ol><li><p>First reader comment with some words.</p></li></ol></div><footer>&copy; all of us</footer></body>',
    # without landmarks: plain fragments, wrappers, and parts that only their place and shape tell apart
    '<body data-content="1"><p>This page is nothing but its own text, in some paragraphs.</p><p>Here is the second one, with more words than the first, for those who read on.</p><p>End.</p></body>',
    '<html><body data-content="1"><h1>Notes</h1><p>A short page of notes.</p><ul><li>First note of the list</li><li>Second note of it</li></ul></body></html>',
    '<body><div data-content="1"><div><div><div><div>Text that stands alone within many wrappers, and goes on for more than a line or two.</div></div></div></div></div></body>',
    '<body><div><a href="/">Start</a> <a href="/n">News</a> <a href="/c">Contact</a></div><div data-content="1"><h2>A piece of news</h2><p>Its first paragraph says what it is about, in a sentence or two that are long enough.</p><p>Its second one adds what was left out of the first, with a good many words.</p></div><div>Copyright by the owner</div></body>',
    '<body><div id="top"><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></div><div id="x" data-content="1"><p>Words of the text, as many as it takes to tell the story to its end.</p><p>And some more of them, so that it is a story.</p></div><div id="y"><div class="z"><b>Ann</b><p>I do not agree with this.</p></div><div class="z"><b>Bob</b><p>But I do, and for good reasons.</p></div><div class="z"><b>Cid</b><p>Thanks for writing.</p></div></div></body>',
    '<body><article data-content="1"><h1>Story</h1><p>The story begins here, with a sentence of some length, as stories do.</p><p>It ends there, after a few more words.</p><div id="q" data-content="0"><div class="k"><i>Dee</i><p>What a fine story, I read it twice.</p></div><div class="k"><i>Eli</i><p>Too long for me.</p></div><div class="k"><i>Fay</i><p>More of these, please, every week.</p></div></div></article></body>',
    '<body><main data-content="1"><section class="part"><h2>Part one</h2><p>The first part of a long text, which has several parts that look alike, and each of them has paragraphs of a good length.</p><p>This is one of those, with enough words to count as long in any case.</p></section><section class="part"><h2>Part two</h2><p>The second part of that text, which looks like the first, as parts of a text should, and is about as long as it.</p><p>A closing paragraph, also with a fair number of words in it.</p></section></main><div id="r"><div class="s">Seen by Gus</div><div class="s">Seen by Hal</div></div></body>',
    '<body><article data-content="1"><h2>Sums</h2><p>The sum is <math><mi>a</mi><mo>+</mo><mi>b</mi></math> for short.</p><figure><img src="p.png"><figcaption>A picture of it</figcaption></figure><dl><dt>Term</dt><dd>What it means</dd></dl></article><p>Posted in sums</p></body>',
    '<body><article data-content="1"><h2>On things</h2><p>Things are many, and this is about some of them, in a few sentences.</p><div class="notice" data-content="0">We changed our terms, please read them.</div><p>One thing is this.</p><div class="promo-box" data-content="0"><p>Get two for one, this week alone.</p></div><p>Another one is that, and so it goes on.</p><div class="comments" data-content="0"><p>I have more things.</p></div></article></body>',
    '<body><main data-content="1"><p>A page with its message first.</p><div class="cookie-bar" data-content="0">This page sets cookies.</div><p>It ends here.</p><div class="share-links" data-content="0">Tell a friend</div></main></body>',
    # lists, tables, quotes and steps with a class, as parts of a text; columns beside it
    '<body><nav><a href="/">Home</a></nav><article data-content="1"><h1>Four things</h1><p>There are four things to say about this, and they follow in the order of their weight.</p><ul><li class="item">One point that is short.</li><li class="item">And one more of them.</li></ul><ol class="steps"><li class="step">Open it.</li><li class="step">Close it.</li></ol><p>That was all of it, as far as anybody knows by now.</p></article></body>',
    '<body><article data-content="1"><h1>Quotes</h1><p>Two people were asked what they think of it, and both of them gave an answer.</p><blockquote class="q">It is good.</blockquote><blockquote class="q">It is not.</blockquote><p>So there is no one answer to this.</p><blockquote><p>Yes.</p></blockquote></article><div class="footer">Some words by the owner</div></body>',
    '<body><nav><a href="/">x</a></nav><main data-content="1"><h1>Figures</h1><table class="t"><tr class="r"><td class="c">One</td><td class="c">1</td></tr><tr class="r"><td class="c">Two</td><td class="c">2</td></tr></table><dl><dt class="d">Term</dt><dd class="d">What it means</dd></dl><p>All of these are figures of last year, or of the year before it.</p></main></body>',
    '<body><article data-content="1"><section class="step"><h2>Step 1</h2><p>Mix the flour.</p></section><section class="step"><h2>Step 2</h2><p>Add some water.</p></section><section class="step"><h2>Step 3</h2><p>Bake.</p></section></article></body>',
    '<body><div id="m" data-content="1"><h1>How to</h1><div class="s"><b>Step 1.</b><p>Take this.</p></div><div class="s"><b>Step 2.</b><p>And that.</p></div><p>Now it is done, and can be used for a long time without any further work.</p></div><div class="right"><h3>Look</h3><p>Other things that may be of use to you.</p><ul><li><a href="/o">One</a></li></ul></div></body>',
    '<body><div class="wrap"><div class="left"><p>Find us in the city, near the old bridge.</p></div><div class="middle" data-content="1"><h1>News</h1><p>There is some news to tell, which takes a sentence or two of middling length.</p><p>And here is the second one of these.</p></div></div></body>',
    '<body><article data-content="1"><h1>Long talk</h1><p>A text that many people have read, and which some of them have written about below.</p><div data-content="0"><div><span>Leo</span><div>I read the whole of it last night and could not stop, although I had to get up early, so thank you for that, and please go on in the same way for as long as you can, as many of us wait for it.</div></div><div><span>Mia</span><div>There is one thing in it that I do not agree with, and that is the end of it, which comes far too soon, so that many things are left open that a reader wants to know by then.</div></div></div></article></body>',
    '<body><nav><ul><li><a href="/">Start</a></li><li><a href="/n">News</a></li></ul></nav><article data-content="1"><h1>Links of the week</h1><p>These are worth a look, and each of them says something that was not said before.</p><ul><li><a href="/p">A first page</a></li><li><a href="/q">A second page</a></li></ul><p><a href="/r">This whole sentence leads to another page, as a paragraph may do now and then.</a></p><figure><img src="f.png"><figcaption>What is seen here</figcaption></figure></article><div class="links"><a href="/s">Imprint</a> <a href="/t">Contact</a></div></body>',
    '<p data-content="1">A fragment</p>',
    '<p data-content="1">One.</p><p data-content="1">Two <i>words</i>.</p>',
    '<body><table><tr><td class="menu"><a href="/a">a</a><br><a href="/b">b</a></td><td class="story" data-content="1"><h1>Old page</h1><p>Text in a table layout, as it used to be done long ago.</p><p>Another paragraph of it.</p></td></tr></table></body>',
]


#: Pages without any markup: their root is content.
PLAIN = ["Nothing but words, as a text file has them.", "A first line of plain text, which is followed by others.\nA second line.\nAnd a third one, longer than both, so that it is a text of some length in all."]


def _names(attrs: str) -> set[str]:
    return {w for m in dom.NAMING.finditer(attrs) for w in re.split(r"[^a-z]+", m[1].lower()) if w}


def _bin(size: int) -> str:
    return "0" if not size else "short" if size < 25 else "middle" if size < 120 else "long"


def _signed(page: dom.Page, size: list[int], group: dict[tuple[int, str, str], list[int]]) -> set[int]:
    """Elements that look like reader comments: two or more siblings with one name and one class, each of which begins with a
    short signature (a name, a time) and has words of its own beside it, where nothing of a text follows them."""
    n = len(page.tag)
    last = list(range(n))  # the last element below each
    for k in range(n - 1, 0, -1):
        last[page.parent[k]] = max(last[page.parent[k]], last[k])
    first: dict[int, tuple[int, str]] = {}  # the element of the first words below each, and these words
    for k, piece in page.stream:
        words = piece and piece.strip()
        if words:
            at = k
            while at >= 0 and at not in first:
                first[at] = (k, words)
                at = page.parent[at]
    goes_on = 0  # the last element that is part of a text
    off = [False] * n
    for k in range(1, n):
        off[k] = off[page.parent[k]] or page.tag[k] in NOT_CONTENT or bool(page.attrs[k] and _names(page.attrs[k]) & BOILERPLATE)
        if page.tag[k] in GOES_ON and size[k] and not off[k]:
            goes_on = k

    def signed(k: int) -> bool:
        by, words = first.get(k, (k, ""))
        return by != k and page.tag[by] in SIGNING and len(words) <= SIGNED_BY and words[-1] not in ".:;?!" and size[k] > size[by]

    out = set()
    for members in group.values():
        if len(members) > 1 and goes_on <= last[members[-1]] and all(map(signed, members)):
            out.update(members)
    return out


def features(page: dom.Page) -> list[tuple[str, ...]]:
    """Names of the features that are on, per element."""
    n = len(page.tag)
    own, linked = [0] * n, [0] * n
    in_link = [False] * n
    alike: dict[tuple[int, str, str], list[int]] = {}
    for k in range(1, n):
        in_link[k] = page.tag[k] == "a" or in_link[page.parent[k]]
        if page.tag[k] in ALIKE:
            shape = _KIND.search(page.attrs[k])
            alike.setdefault((page.parent[k], page.tag[k], shape[1] if shape else ""), []).append(k)
    for k, piece in page.stream:
        if piece:
            c = len(piece.strip())
            own[k] += c
            if in_link[k]:
                linked[k] += c
    size = own[:]
    for k in range(n - 1, 0, -1):
        size[page.parent[k]] += size[k]
        linked[page.parent[k]] += linked[k]
    signed = _signed(page, size, {shape: group for shape, group in alike.items() if len(group) > 1})
    comment = [k in signed for k in range(n)]
    mark = "main" if "main" in page.tag else "article"
    inside = [False] * n
    marked = mark in page.tag
    beside = [False] * n  # within an element that is named as a part beside the text, or by its place, and holds less than half of the page
    bare = not any(tag in SIDE or attrs and _names(attrs) for tag, attrs in zip(page.tag, page.attrs))
    out = []
    for k in range(n):
        tag, attrs = page.tag[k], page.attrs[k]
        f = ["bias", "tag:" + (tag if tag in NAMED else "h3" if tag in ("h4", "h5", "h6") else "none" if tag in NOT_CONTENT else "other")]
        if k:
            up = page.parent[k]
            inside[k] = inside[up] or tag == mark
            beside[k] = beside[up]
            comment[k] = comment[k] or comment[up]
        if marked and not inside[k]:
            f.append("outside")
        if bare:
            f.append("bare")
        if comment[k]:
            f.append("signed")
        if attrs:
            names = _names(attrs)
            if names & BOILERPLATE:
                f.append("named:boilerplate")
                beside[k] = beside[k] or not names & CONTENT and 2 * size[k] < size[0]
            if names & CONTENT:
                f.append("named:content")
            elif names & PLACE:
                f.append("named:place")
                beside[k] = beside[k] or 2 * size[k] < size[0]
            if dom.HIDDEN.search(attrs):
                f.append("hidden")
        if beside[k]:
            f.append("beside")
        f.append("size:" + _bin(size[k]))
        f.append("own:" + _bin(own[k]))
        if size[k]:
            share = linked[k] / size[k]
            f.append("links:none" if not share else "links:some" if share < 0.4 else "links:most inside" if inside[k] else "links:most")
        out.append(tuple(f))
    return out


class TreeModel:
    """Weights of the features, and log-potentials of (parent, child) pairs of labels."""

    def __init__(self) -> None:
        self.weight: dict[str, float] = {}
        self.pair = [[0.0, 0.0], [0.0, 0.0]]

    def messages(self, feats: list[tuple[str, ...]], parent: list[int]) -> tuple[list[float], list[float], list[float]]:
        """Log-odds of content below and at each node, its message up, and its message from above."""
        get, memo = self.weight.get, {}
        below = []
        for f in feats:
            if f not in memo:
                memo[f] = sum(get(x, 0.0) for x in f)
            below.append(memo[f])
        (e00, e01), (e10, e11) = [[math.exp(x) for x in row] for row in self.pair]
        exp, log = math.exp, math.log
        up, down = [0.0] * len(feats), [0.0] * len(feats)
        for k in range(len(feats) - 1, 0, -1):  # children stand after their parents
            b = exp(max(-30.0, min(30.0, below[k])))
            up[k] = log((e10 + e11 * b) / (e00 + e01 * b))
            below[parent[k]] += up[k]
        for k in range(1, len(feats)):
            p = parent[k]
            d = exp(max(-30.0, min(30.0, below[p] + down[p] - up[k])))
            down[k] = log((e01 + e11 * d) / (e00 + e10 * d))
        return below, up, down

    def marginals(self, feats: list[tuple[str, ...]], parent: list[int]) -> list[float]:
        below, _, down = self.messages(feats, parent)
        return [1 / (1 + math.exp(-max(-30.0, min(30.0, b + d)))) for b, d in zip(below, down)]

    def fit(self, pages: list[tuple[list[tuple[str, ...]], list[int], list[int]]], rounds: int = 240, rate: float = 0.5, decay: float = 0.001) -> TreeModel:
        """Gradient ascent on the mean log-likelihood of ``(features, parent, label)`` pages, each page with equal weight."""
        for _ in range(rounds):
            grad: dict[str, float] = {}
            pair = [[0.0, 0.0], [0.0, 0.0]]
            for feats, parent, label in pages:
                share = 1.0 / len(feats)
                below, up, down = self.messages(feats, parent)
                for k, f in enumerate(feats):
                    p = 1 / (1 + math.exp(-max(-30.0, min(30.0, below[k] + down[k]))))
                    for x in f:
                        grad[x] = grad.get(x, 0.0) + share * (label[k] - p)
                    if k:
                        q = parent[k]
                        top = max(-30.0, min(30.0, below[q] + down[q] - up[k]))
                        own = max(-30.0, min(30.0, below[k]))
                        e = [[math.exp(a * top + b * own + self.pair[a][b]) for b in (0, 1)] for a in (0, 1)]
                        total = sum(map(sum, e))
                        for a in (0, 1):
                            for b in (0, 1):
                                pair[a][b] += share * ((label[q] == a and label[k] == b) - e[a][b] / total)
            n = len(pages)
            for x, g in grad.items():
                self.weight[x] = self.weight.get(x, 0.0) + rate * (30 * g / n - decay * self.weight.get(x, 0.0))
            for a in (0, 1):
                for b in (0, 1):
                    self.pair[a][b] += rate * (3 * pair[a][b] / n - decay * self.pair[a][b])
        return self


def labels_of(page: dom.Page) -> list[int]:
    """Labels from data-content marks and HTML landmarks, inherited from parents; names of classes play no part."""
    out = [0] * len(page.tag)
    for k in range(1, len(page.tag)):
        mark = dom.LABEL.search(page.attrs[k])
        tag = page.tag[k]
        if mark:
            out[k] = int(mark[1])
        elif tag in NOT_CONTENT:
            out[k] = 0
        else:
            out[k] = 1 if tag in ("article", "main") else out[page.parent[k]]
    return out


def _example(html: str) -> tuple[list[tuple[str, ...]], list[int], list[int]]:
    page = dom.read(html)
    return features(page), page.parent, labels_of(page)


def hand_labelled() -> list[tuple[list[tuple[str, ...]], list[int], list[int]]]:
    plain = [dom.read(text) for text in PLAIN]
    return [_example(h) for h in LABELLED] * 2 + [(features(p), p.parent, [1] * len(p.parent)) for p in plain] * 2


def train(pages: DataFrame, sample: int = SAMPLE_PAGES, max_nodes: int = MAX_NODES) -> TreeModel:
    """A model from ``LABELLED`` and at most ``sample`` pages of at most ``max_nodes`` elements that mark their article."""
    marked = pages.where(F.col("html").rlike("(?i)<(article|main)[ >]")).where(F.length("html") < 40 * max_nodes).withColumn("h", F.xxhash64("html"))
    # the least hashes first, as numbers; then just their pages come to the driver, copies once
    least = [r.h for r in marked.groupBy("h").count().orderBy("h").select("h").limit(sample).collect()]
    chosen = marked.where(F.col("h") <= least[-1]).select("html").distinct().orderBy("html").collect() if least else []
    examples = hand_labelled() + [e for e in (_example(r.html) for r in chosen) if len(e[0]) <= max_nodes]
    return TreeModel().fit(examples)


def main_text(html: str, model: TreeModel) -> str:
    page = dom.read(html)
    wanted = [p >= 0.5 for p in model.marginals(features(page), page.parent)]
    return "\n".join(dom.blocks(page, wanted))


def extract(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages``."""
    model = model or train(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            texts = [main_text(h, model) if h else "" for h in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col("html").alias("text")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
