"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

``leaf_blocks`` reads a page by its tags and cuts its text where block
elements begin and end; scripts, styles, templates, frames, the head, values of
form fields and comments of the markup hold no text, all else is left to the
field (that an element is hidden is a feature). Each block is described by the tags and
the words of the class, id and role attributes of its ancestors, and by its
text: length, share of link text, end of sentence, and so on. A chain with two
labels (main text or not) is trained by its log-likelihood on labelled pages;
blocks are labelled by Viterbi. ``training_pages`` makes labelled pages of many
layouts by rule; any other labelled blocks can be given.

Text: character references are decoded, runs of white space inside a block
become one space, blocks are trimmed and joined in page order by two newlines.

Defined cases: a null or empty page, and one whose blocks are all boilerplate,
give an empty text; unclosed and stray tags, quotes and comments are read as
far as they go; repeated rows are each extracted; an empty table gives an empty
result; other columns are ignored, whatever their names. Pages of any length
are read whole, in time proportional to their length.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._cluster import columns_of, table
from ._words import batch_of

#: A tag whose quoted values close, and one that ends at its first ">".
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([^\s=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img rp rt ruby button object canvas svg math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup semantics annotation g text tspan".split())
#: What holds no text of the page: its head, programs, styles, frames, and the values of form fields.
SILENT = frozenset("head script style template noframes iframe select textarea datalist noembed title".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]), "body": frozenset(["head"]), "thead": frozenset(["thead"]), "tbody": frozenset(["thead", "tbody"]), "tfoot": frozenset(["tbody"]),
}
BARRIER = frozenset("table ul ol dl body html div section article main aside td th blockquote".split())
LISTS = frozenset("table ul ol dl html".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt".split())
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Block(NamedTuple):
    text: str
    node: tuple[str, ...]
    """Features of the ancestors."""
    tag: str
    link_share: float


@lru_cache(maxsize=50_000)
def own_features(tag: str, attributes: str) -> tuple[str, ...]:
    """Of an element: its tag, and the words of its class, id and role."""
    out = [f"t:{tag}"]
    for name, *values in ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        if (name := name.lower()) in ("class", "id", "role", "itemprop", "aria-label"):
            out += [f"c:{w.lower()}" for w in NAME_PARTS.findall(html.unescape(value))]
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            out.append("hidden")
    return tuple(dict.fromkeys(out))


class Element(NamedTuple):
    tag: str
    features: tuple[str, ...]
    """With those of its ancestors."""
    silent: bool
    linked: bool
    owner: Element | None
    """The nearest element that isn't inline, itself if this is None."""


def read_tags(page: str) -> Iterator[tuple[str, bool, str, str, int]]:
    """(text before, whether it closes, tag, attributes, where it ends) of each tag in order; last the rest, with an empty tag.

    Nothing is read twice: from a tag whose quotes or ">" never come, tags end at their first ">".
    """
    at, n, last, last_data, plain = 0, len(page), page.rfind(">"), page.rfind("]]>"), False
    begin = at
    while True:
        at = page.find("<", at)
        if at < 0 or at > last and not page.startswith("<!--", at):
            yield page[begin:], False, "", "", n
            return
        end = -1
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4) + 3
            end = end if end > 2 else n
        elif page.startswith("<![CDATA[", at) and at < last_data:
            end = page.find("]]>", at) + 3
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at) + 1
        if end > 0:
            yield page[begin:at], False, "!", "", end
            at = begin = end
            continue
        m = None
        if page[at + 1 : at + 2].isalpha() or page[at + 1 : at + 2] == "/":
            m = None if plain else TAG.match(page, at)
            if m is None:
                m = PLAIN_TAG.match(page, at)
                plain = plain or m is not None
        if m is None:
            at += 1
            continue
        jump = yield page[begin:at], bool(m[1]), m[2].lower(), m[3], m.end()
        at = begin = m.end() if jump is None else jump


def leaf_blocks(page: str, known: dict[str, float] | None = None) -> list[Block]:
    """The page's blocks of text in order. known: the features that matter (others aren't kept)."""
    blocks: list[Block] = []
    stack = [Element("", (), False, False, None)]
    opened: Counter[str] = Counter()
    text: list[str] = []
    linked, owner = 0, stack[0]

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                blocks.append(Block(joined, owner.features, owner.tag, min(1.0, linked / len(joined))))
            text.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked, owner
        top = stack[-1]
        if raw and not top.silent:
            raw = html.unescape(raw) if "&" in raw else raw
            if not text or not owner.features:
                owner = top.owner or top
            text.append(raw)
            if top.linked:
                linked += len(raw.strip())

    def pop_to(i: int) -> None:
        if any(e.tag not in INLINE for e in stack[i:]):
            flush()
        opened.subtract(e.tag for e in stack[i:])
        del stack[i:]

    def pop(tags: frozenset[str], within: frozenset[str]) -> None:
        """Closes the last open element of these tags, unless one of ``within`` was opened after it."""
        if any(opened[t] > 0 for t in tags):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in tags:
                    return pop_to(i)
                if stack[i].tag in within:
                    return None
        return None

    tags = read_tags(page)
    jump = None
    while True:
        try:
            before, close, tag, attributes, end = tags.send(jump)
        except StopIteration:
            break
        jump = None
        add(before)
        if tag in ("", "!"):
            continue
        if close:
            if tag == "p" and opened["p"] <= 0:
                flush()
            if opened[tag] > 0:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        pop_to(i)
                        break
                    if tag in INLINE and stack[i].tag not in INLINE or stack[i].tag in ("td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                        break
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        if tag in ENDS_P:
            pop(frozenset(["p"]), BARRIER)
        if tag in CLOSES:
            pop(CLOSES[tag], LISTS)
        if attributes.endswith("/") and tag not in INLINE and tag not in ENDS_P:
            continue
        top = stack[-1]
        own = own_features(tag, attributes)
        plain = tag in INLINE and len(own) == 1
        if known is not None:
            own = tuple(f for f in own if f in known)
        features = top.features if plain else tuple(dict.fromkeys([*top.features, *own]))
        stack.append(Element(tag, features, top.silent or tag in SILENT, top.linked or tag == "a", (top.owner or top) if tag in INLINE else None))
        opened[tag] += 1
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, end)
            jump = found.start() if found else len(page)
            add(page[end:jump])
    flush()
    return blocks


def text_features(block: Block) -> list[str]:
    text = block.text
    n = text.count(" ") + 1
    size = 0 if n <= 2 else 1 if n <= 5 else 2 if n <= 10 else 3 if n <= 20 else 4 if n <= 40 else 5 if n <= 80 else 6
    out = ["bias", f"size{size}", f"link{min(4, int(block.link_share * 4.999))}", f"tag:{block.tag}", f"end:{text[-1] in '.!?:;\"”»'}", f"comma:{',' in text}"]
    if "©" in text[:40] or "copyright" in text[:60].lower() or "all rights reserved" in text.lower():
        out.append("rights")
    if text[:1].isupper():
        out.append("capital")
    if "|" in text or "·" in text or "»" in text:
        out.append("bars")
    if "@" in text or "http" in text:
        out.append("address")
    return out


class Field(NamedTuple):
    """Weights of the feature for main text (the other label is the base), of the first block, and of label pairs."""

    weights: dict[str, float]
    first: np.ndarray
    pairs: np.ndarray


def node_scores(field: Field, blocks: list[Block], known: dict[tuple[str, ...], float]) -> np.ndarray:
    out = np.empty(len(blocks))
    w = field.weights
    for i, b in enumerate(blocks):
        if (s := known.get(b.node)) is None:
            s = known[b.node] = sum(w.get(f, 0.0) for f in b.node)
        out[i] = s + sum(w.get(f, 0.0) for f in text_features(b))
    return out


def viterbi(field: Field, score: np.ndarray) -> list[bool]:
    """The best labels of a chain with the given scores for main text."""
    if not len(score):
        return []
    (a, b), ((p00, p01), (p10, p11)) = field.first.tolist(), field.pairs.tolist()
    zero, one = a, b + score[0]
    back: list[tuple[bool, bool]] = []
    for s in score[1:].tolist():
        from_zero, from_one = one + p10 > zero + p00, one + p11 > zero + p01
        back.append((from_zero, from_one))
        zero, one = max(zero + p00, one + p10), max(zero + p01, one + p11) + s
    labels = [one > zero]
    for from_zero, from_one in reversed(back):
        labels.append(from_one if labels[-1] else from_zero)
    return labels[::-1]


def marginals(field: Field, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of main text, summed expected label pairs) of a chain."""
    n = len(score)
    unary = np.stack([np.zeros(n), score], 1)
    f, b = np.zeros((n, 2)), np.zeros((n, 2))
    f[0] = field.first + unary[0]
    for i in range(1, n):
        f[i] = np.logaddexp(f[i - 1, 0] + field.pairs[0], f[i - 1, 1] + field.pairs[1]) + unary[i]
    for i in range(n - 2, -1, -1):
        x = b[i + 1] + unary[i + 1]
        b[i] = np.logaddexp(field.pairs[:, 0] + x[0], field.pairs[:, 1] + x[1])
    z = np.logaddexp(f[-1, 0], f[-1, 1])
    pairs = np.zeros((2, 2))
    if n > 1:
        joint = f[:-1, :, None] + field.pairs[None] + (b[1:] + unary[1:])[:, None, :] - z
        pairs = np.exp(joint).sum(0)
    return np.exp(f[:, 1] + b[:, 1] - z), pairs


def train(pages: list[tuple[list[Block], list[bool]]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """A field for labelled chains, by adaptive gradient steps on the log-likelihood, one page a step."""
    field = Field({}, np.zeros(2), np.zeros((2, 2)))
    squares: dict[str, float] = {}
    first2, pairs2 = np.full(2, 1e-8), np.full((2, 2), 1e-8)
    chains = [([[*b.node, *text_features(b)] for b in blocks], np.array(labels, float)) for blocks, labels in pages if blocks]
    rng = random.Random(1)
    for _ in range(rounds):
        rng.shuffle(chains)
        for names, y in chains:
            w = field.weights
            p, expected = marginals(field, np.array([sum(w.get(f, 0.0) for f in row) for row in names]))
            step: dict[str, float] = {}
            for row, d in zip(names, (y - p).tolist(), strict=True):
                if abs(d) > 1e-4:
                    for f in row:
                        step[f] = step.get(f, 0.0) + d
            for f, g in step.items():
                g -= decay * w.get(f, 0.0)
                squares[f] = squares.get(f, 1e-8) + g * g
                w[f] = w.get(f, 0.0) + rate * g / squares[f] ** 0.5
            k = y.astype(int)
            seen = np.zeros((2, 2))
            np.add.at(seen, (k[:-1], k[1:]), 1)
            g1, g2 = np.eye(2)[k[0]] - np.array([1 - p[0], p[0]]), seen - expected
            first2 += g1**2
            pairs2 += g2**2
            field.first[:] += rate * g1 / np.sqrt(first2)
            field.pairs[:] += rate * g2 / np.sqrt(pairs2)
    return field


def training_pages(n: int = 500, seed: int = 17) -> list[tuple[str, list[str]]]:
    """Made-up pages of many layouts, each with the blocks of its main text."""
    rng = random.Random(seed)
    parts = "ra mo lu ka sel vin dor per tal nor mi th re on an er ti in at ou ha be st ing ed de la le en un que der die ung".split()
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: words(3, 16).capitalize() + rng.choice([".", ".", ".", "?", "!", ","])
    prose = lambda: " ".join(sentence() for _ in range(rng.randint(1, 7)))
    junk = {
        "nav": ("nav menu navbar navigation breadcrumb breadcrumbs topnav mainmenu subnav toc", "nav div ul"),
        "header": ("header masthead top banner siteheader branding logo tagline", "header div"),
        "footer": ("footer bottom foot copyright legal colophon siteinfo imprint", "footer div"),
        "side": ("sidebar aside widget related recommended popular trending side rail more teaser newsletter tags archive promo", "aside div section"),
        "notice": ("notice cookie cookies consent gdpr alert message banner popup modal overlay paywall subscribe privacy warning", "div section aside p"),
        "ad": ("ad ads advert advertisement sponsor sponsored promo banner adsbox commercial", "div aside section ins p"),
        "form": ("form search login signup subscribe newsletter contact poll", "form div"),
        "comments": ("comments comment discussion replies reply respond disqus reader thread responses", "section div ol ul"),
        "share": ("share social sharing follow buttons tools print meta byline pagination pager", "div ul p"),
    }
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'

    def box(kind: str) -> str:
        names, tags = junk[kind]
        tag = rng.choice(tags.split())
        name = rng.choice(names.split())
        name = rng.choice([name, f"{name}-{word()}", f"{word()}_{name}", f"{name} {word()}", f"{name}{rng.randint(1, 9)}"])
        semantic = tag in ("nav", "header", "footer", "aside", "form", "ins")
        attribute = "" if semantic and rng.random() < 0.5 or rng.random() < 0.04 else f' {rng.choice(["class", "class", "id"])}="{name}"'
        if kind in ("nav", "share") or kind == "side" and rng.random() < 0.5:
            inner = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 8)))
            inner = inner if tag == "ul" else f"<ul>{inner}</ul>" if rng.random() < 0.7 else " | ".join(link() for _ in range(4))
        elif kind == "footer":
            inner = rng.choice(["&copy; ", "© ", "Copyright ", ""]) + rng.choice([words(2, 9), f"{word()}.example.org &middot; {prose()}", f"<p>{prose()}</p><p>{link()} {link()}</p>"])
        elif kind == "form":
            inner = f"<label>{words(1, 4)}</label><input name=q><button>{word()}</button>" + rng.choice(["", f"<p>{sentence()}</p>"])
        elif kind == "comments":
            inner = f"<h{rng.choice('234')}>{words(1, 3)}</h3>" + "".join(rng.choice([f'<div class="comment"><p>{prose()}</p></div>', f"<li><b>{word()}</b><p>{prose()}</p></li>", f"<p>{prose()}</p>", f"<div>{prose()}</div>"]) for _ in range(rng.randint(1, 5)))
        elif tag == "p":
            inner = prose()
        else:
            inner = rng.choice([prose(), f"<p>{prose()}</p>", f"<p>{sentence()} {link()}</p>", f"<h3>{words(1, 5)}</h3><p>{prose()}</p>", f"<div>{prose()}</div>", f"<span>{sentence()}</span>"])
        if rng.random() < 0.06:
            attribute += rng.choice([" hidden", ' style="display: none"', ' aria-hidden="true"'])
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def main() -> tuple[str, list[str]]:
        out, blocks = [], []

        def say(tag: str, text: str, mark: str = "") -> None:
            blocks.append(" ".join(text.split()))
            out.append(f"<{tag}>{mark or text}" + (f"</{tag}>" if rng.random() < 0.95 or tag != "p" else ""))

        if rng.random() < 0.85:
            say(rng.choice(["h1", "h1", "h1", "h2"]), words(2, 12))
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            if kind < 0.66:
                text = prose()
                say("p", text, rng.choice(["", "", f"<b>{text}", f"<em>{text}</em>", text.replace(" ", f" <a href='/{word()}'>", 1) + "</a>" if text.count(" ") < 3 else ""]))
            elif kind < 0.74:
                say(rng.choice(["h2", "h3"]), words(1, 8))
            elif kind < 0.82:
                out.append("<ul>")
                for _ in range(rng.randint(1, 4)):
                    say("li", words(2, 14))
                out.append("</ul>")
            elif kind < 0.87:
                out.append("<blockquote>")
                say("p", prose())
                out.append("</blockquote>")
            elif kind < 0.91:
                say("pre", words(4, 12))
            elif kind < 0.95:
                out.append("<table>")
                for _ in range(rng.randint(1, 3)):
                    out.append("<tr>")
                    say("td", words(1, 6))
                    say("td", words(1, 6))
                    out.append("</tr>")
                out.append("</table>")
            elif kind < 0.965:
                say("p", words(1, 3) + ".")
            elif kind < 0.985:  # lines that look like boilerplate but belong to the article
                say("p", rng.choice(["All rights reserved.", f"Copyright (c) {words(1, 3)}. All rights reserved.", f"Released under the {word()} License.", f"{words(1, 2)} |", " | ".join(words(1, 2) for _ in range(3)), f"{word()}@example.org", words(1, 2)]))
            else:
                out.append(box(rng.choice(["ad", "share", "side", "notice"])))
        return "".join(out), blocks

    pages = []
    good = "content article post entry story body text main page prose".split()
    for _ in range(n):
        kinds = [k for k in junk if rng.random() < 0.5]
        rng.shuffle(kinds)
        before = [k for k in kinds if k in ("nav", "header", "notice", "ad", "form") or k == "side" and rng.random() < 0.5]
        after = [k for k in kinds if k not in before]
        inner, blocks = main()
        name = rng.choice(good)
        tag = rng.choice(["article", "article", "main", "div", "section", "div"])
        whole = f"<{tag}{'' if tag in ('article', 'main') and rng.random() < 0.6 else f' class=\"{rng.choice([name, name + '-' + rng.choice(good), word() + '-' + name])}\"'}>{inner}"
        tail = ""
        if "comments" in after and rng.random() < 0.3:  # readers' comments inside the article
            after.remove("comments")
            tail = box("comments")
        whole += f"{tail}</{tag}>"
        if rng.random() < 0.3:
            whole = f"<main>{whole}</main>" if tag != "main" else f"<div id=wrapper>{whole}</div>"
        pages.append((f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{}}</style></head><body>{''.join(map(box, before))}{whole}{''.join(map(box, after))}</body></html>", blocks))
    return pages


def labelled(pages: list[tuple[str, list[str]]]) -> list[tuple[list[Block], list[bool]]]:
    """Blocks with their labels: a block is main text if its text is the next of the page's main blocks."""
    out = []
    for page, main in pages:
        blocks, k, labels = leaf_blocks(page), 0, []
        for b in blocks:
            labels.append(k < len(main) and b.text == main[k])
            k += labels[-1]
        out.append((blocks, labels))
    return out


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled(training_pages()))


def main_blocks(page: str | None, field: Field, known: dict[tuple[str, ...], float] | None = None) -> list[str]:
    blocks = leaf_blocks(page or "", field.weights)
    return [b.text for b, good in zip(blocks, viterbi(field, node_scores(field, blocks, {} if known is None else known)), strict=True) if good]


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text for each row of ``pages`` (page_id, url, html)."""
    pages = columns_of(pages, {"page_id": "long", "url": "string", "html": "string"})
    shared = pages.sparkSession.sparkContext.broadcast(field or default_field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, ...], float] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                if len(known) > 20_000:
                    known.clear()
                texts = ["\n\n".join(main_blocks(x, shared.value, known)) for x in part.column("html").to_pylist()]
                yield batch_of(page_id=part.column("page_id"), url=part.column("url"), text=pa.array(texts, pa.string()))

    return pages.mapInArrow(run, "page_id long, url string, text string")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
