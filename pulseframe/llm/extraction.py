"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into the runs of text between block-level tags. Each run is described by the tags,
classes and roles of the elements it stands in and by its own text: length, links, marks, place
on the page. The field scores the whole sequence of runs, so that a short line between two
paragraphs is told from one in a menu, and Viterbi decoding picks the best sequence. It is
trained on labelled pages; :func:`labelled_pages` composes some in many layouts.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

PAGES = 500
EPOCHS = 6
RATE = 0.3
DECAY = 1e-5

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Fixed values of the HTML standard: elements inside a line of text, without end tag, without text to read.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr "
    "object math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle "
    "semantics annotation annotation-xml".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style noscript template svg annotation annotation-xml iframe textarea select title canvas audio video".split())
#: Where unread elements end. A title ends with its head at the latest.
HEAD_END = r"</head(?=[\s/>])|<body(?=[\s/>])"
ENDS = {t: re.compile(rf"</{t}(?=[\s/>])" + f"|{HEAD_END}" * (t == "title"), re.I | re.A) for t in UNREAD}
LEFT_OPEN = re.compile(HEAD_END, re.I | re.A)
#: Start tags that end an open element, up to the container named.
ENDED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
PARAGRAPH_STOPS = frozenset("body article section div td th li blockquote main aside header footer nav form figure dd".split())


@dataclass
class Block:
    text: str
    features: frozenset[str]
    tag: str
    linked: int
    chain: str


def _own_features(tag: str, attributes: str, known: dict) -> frozenset[str]:
    key = (tag, attributes)
    if key not in known:
        found = {"t:" + tag}
        for name, value in ATTRIBUTE.findall(attributes):
            found.update("c:" + p.lower() for p in PIECE.findall(value))
            if name.lower() == "role":
                found.add("r:" + value.strip("\"'").lower())
        if len(known) > 20_000:
            known.clear()
        known[key] = frozenset(found)
    return known[key]


def blocks(html: str, known: dict | None = None) -> list[Block]:
    """Leaf blocks of a page, in order, with white space in each turned into single spaces."""
    known = {} if known is None else known
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str], str]] = [("html", frozenset(), "")]
    parts: list[str] = []
    linked = links = 0
    at = 0
    endless: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                block, features, chain = next(x for x in reversed(stack) if x[0] not in INLINE)
                out.append(Block(text, features | stack[-1][1], block, min(linked, len(text)), chain))
            parts.clear()
        linked = 0

    def close(index: int) -> None:
        nonlocal links
        links -= sum(x[0] == "a" for x in stack[index:])
        del stack[index:]

    # Behind the last ">" no tag ends, and none need be looked for.
    last = html.rfind(">") + 1
    stop = len(html) if html.rfind("<!--") >= last else last
    while True:
        found = TOKEN.search(html, at, stop) if at < stop else None
        text = html[at : found.start()] if found else html[at:]
        if text:
            parts.append(text)
            if links:
                linked += len(text.strip())
        if not found:
            break
        at = found.end()
        name = found[2] or found[5]
        if not name:
            continue
        tag, ending = name.lower(), found[1] or found[4]
        if tag == "br":
            parts.append("\n")
            continue
        inline = tag in INLINE
        if ending:
            if not inline:
                flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if inline and stack[i][0] not in INLINE:
                    break
            continue
        attributes = found[3] or found[6] or ""
        if not inline:
            flush()
            if tag not in VOID:
                if tag in ENDED:
                    ended, stops = ENDED[tag]
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] in stops:
                            break
                        if stack[i][0] in ended:
                            close(i)
                            break
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in PARAGRAPH_STOPS:
                        break
                    if stack[i][0] == "p":
                        close(i)
                        break
        if tag in UNREAD:
            if not attributes.endswith("/"):
                end = None if tag in endless else ENDS[tag].search(html, at)
                if not end:
                    endless.add(tag)
                    end = None if "head" in endless else LEFT_OPEN.search(html, at)
                    if not end:
                        endless.add("head")
                at = end.start() if end else len(html)
            continue
        # A head holds nothing but unread and void elements; its end tag may be left out.
        if tag in VOID or tag == "head":
            continue
        if tag == "a":
            links += 1
        own, (_, above, chain) = _own_features(tag, attributes, known), stack[-1]
        if not inline:
            # The way down from the nearest container, with a point for each element that is named.
            step = tag if len(own) == 1 else tag + "."
            chain = step if tag in ("article", "main", "body") else f"{chain}>{step}"[-40:]
        stack.append((tag, above | own, chain))
    flush()
    return out


BUCKETS = (1, 2, 3, 5, 8, 12, 20, 40, 80)


def described(page: list[Block]) -> list[list[str]]:
    """Features of each block of a page."""
    out = []
    n = len(page)
    for i, block in enumerate(page):
        text = block.text
        words = text.count(" ") + 1
        size = sum(words > b for b in BUCKETS)
        link = round(4 * block.linked / len(text))
        end = text[-1]
        mark = "." if end in ".!?…\"”»" else ":" if end in ":;," else "a" if end.isalnum() else "x"
        found = [
            "one",
            f"len{size}",
            f"link{link}",
            f"end{mark}",
            f"len{size}link{link}",
            f"len{size}end{mark}",
            f"at{10 * i // n}",
            f"tag:{block.tag}",
            f"chain:{block.chain}",
            f"tag:{block.tag}link{link}",
            f"tag:{block.tag}len{min(size, 5)}",
        ]
        if "©" in text or "opyright" in text:
            found.append("copyright")
        if "|" in text or "·" in text or "»" in text:
            found.append("bars")
        if text.count(",") > 1:
            found.append("commas")
        if text.isupper():
            found.append("upper")
        if block.features & INSIDE:
            found.append("inside")
            found.append(f"inside{block.tag}")
        found.extend(block.features)
        out.append(found)
    return out


INSIDE = frozenset({"t:article", "t:main", "r:main", "r:article"})


@dataclass
class Field:
    """Weights of features for main text, and of label pairs: ``pairs[before][after]``."""

    weights: dict[str, float]
    pairs: tuple[tuple[float, float], tuple[float, float]]

    def decode(self, page: list[list[str]]) -> list[bool]:
        """Viterbi: the best sequence of labels."""
        weigh = self.weights.get
        (stay_out, enter), (leave, stay_in) = self.pairs
        out = inside = 0.0
        back: list[tuple[bool, bool]] = []
        for i, found in enumerate(page):
            score = sum([weigh(f, 0.0) for f in found])
            if i:
                from_out, from_in = out + enter, inside + stay_in
                to_out, to_in = out + stay_out, inside + leave
                back.append((to_in > to_out, from_in >= from_out))
                out, inside = max(to_out, to_in), max(from_out, from_in) + score
            else:
                inside = score
        label = inside > out
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1] if page else []


def fit(pages: Iterable[tuple[list[list[str]], list[bool]]], epochs: int = EPOCHS, rate: float = RATE) -> Field:
    """Maximises the likelihood of the labels by stochastic gradient steps, page by page."""
    data = [(p, np.array(y, int)) for p, y in pages if p]
    names = {f: i for i, f in enumerate(sorted({f for p, _ in data for b in p for f in b}))}
    rows = [([np.array([names[f] for f in b]) for b in p], y) for p, y in data]
    weights, pairs = np.zeros(len(names)), np.zeros((2, 2))
    seen, seen_pairs = np.full(len(names), 1e-6), np.full((2, 2), 1e-6)
    order = list(range(len(rows)))
    shuffle = random.Random(5).shuffle
    for _ in range(epochs):
        shuffle(order)
        for at in order:
            page, y = rows[at]
            n = len(page)
            score = np.zeros((n, 2))
            score[:, 1] = [weights[b].sum() for b in page]
            ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
            ahead[0] = score[0]
            for i in range(1, n):
                ahead[i] = np.logaddexp.reduce(ahead[i - 1][:, None] + pairs, axis=0) + score[i]
            for i in range(n - 2, -1, -1):
                behind[i] = np.logaddexp.reduce(pairs + (score[i + 1] + behind[i + 1])[None, :], axis=1)
            total = np.logaddexp.reduce(ahead[-1])
            error = y - np.exp(ahead[:, 1] + behind[:, 1] - total)
            slope_pairs = np.zeros((2, 2))
            for i in range(1, n):
                slope_pairs[y[i - 1], y[i]] += 1
                slope_pairs -= np.exp(ahead[i - 1][:, None] + pairs + (score[i] + behind[i])[None, :] - total)
            slope = np.bincount(np.concatenate(page), np.repeat(error, [len(b) for b in page]), len(weights)) - DECAY * weights
            seen += slope**2
            seen_pairs += slope_pairs**2
            weights += rate * slope / np.sqrt(seen)
            pairs += rate * slope_pairs / np.sqrt(seen_pairs)
    kept = {f: float(weights[i]) for f, i in names.items() if abs(weights[i]) > 1e-4}
    return Field(kept, tuple(map(tuple, pairs.tolist())))


#: Elements, and words of classes, by which layouts name their parts.
NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs pagination tabs links toolbar skip",
    "header": "header masthead topbar logo brand site-header branding tagline",
    "footer": "footer site-footer copyright legal colophon bottom imprint",
    "aside": "sidebar widget secondary related recommended popular trending tags rail more teaser",
    "notice": "cookie consent gdpr notice alert banner popup modal newsletter subscribe paywall privacy toast",
    "ad": "ad ads advert advertisement sponsored promo sponsor adsbox outbrain",
    "form": "form search login signup contact subscribe-form",
    "comments": "comments comment reply discussion respond disqus comment-list responses",
    "share": "share social sharing follow buttons",
}
TAGS = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}
CONTENT = "content post entry-content article-body main story text body post-content page article entry"


def labelled_pages(count: int = PAGES, seed: int = 11) -> Iterator[tuple[list[list[str]], list[bool]]]:
    """Features and labels of composed pages: random layouts, names and words."""
    pick = random.Random(seed)
    letters = ["an", "er", "th", "ou", "on", "le", "de", "qu", "sch", "ci", "re", "st", "en", "ä", "é", "ñ", "ta", "mo"]

    def words(low: int, high: int, end: str = ".") -> str:
        some = ["".join(pick.choices(letters, k=pick.randint(1, 4))) for _ in range(pick.randint(low, high))]
        some[0] = some[0].capitalize()
        return " ".join(w + ("," if pick.random() < 0.08 else "") for w in some[:-1]) + " " * (len(some) > 1) + some[-1] + end

    def name(kind: str) -> str:
        words_of = pick.choice((CONTENT if kind == "content" else NAMES[kind]).split())
        form = pick.random()
        if form < 0.6:
            return f' class="{words_of}"' if pick.random() < 0.6 else f" class='{words_of} {pick.choice(['box', 'wrap', 'col', 'inner'])}'"
        return f' id="{words_of}"' if form < 0.8 else ""

    for _ in range(count):
        truth: dict[str, bool] = {}

        def said(text: str, main: bool, truth: dict[str, bool] = truth) -> str:
            truth[" ".join(text.split())] = main
            return text

        def boiler(kind: str) -> str:
            tag = TAGS.get(kind, "div") if pick.random() < 0.6 else "div"
            named = name(kind) if tag == "div" and kind != "form" or pick.random() < 0.6 else ""
            if tag == "div" and not named:
                named = f' class="{NAMES[kind].split()[0]}"'
            if kind in ("nav", "share") or kind in ("footer", "aside", "header") and pick.random() < 0.4:
                rows = [f'<li><a href="#">{said(words(1, 4, ""), False)}</a></li>' for _ in range(pick.randint(2, 9))]
                inner = "<ul>" + "".join(rows) + "</ul>"
                if pick.random() < 0.3:
                    inner = " ".join(f'<div><a href="#">{said(words(1, 3, ""), False)}</a></div>' for _ in range(4))
            elif kind == "form":
                inner = f"<label>{said(words(1, 5, ':'), False)}</label><input><button>{said(words(1, 2, ''), False)}</button>"
                if pick.random() < 0.5:
                    inner = f"<p>{said(words(4, 20), False)}</p>" + inner
            elif kind == "comments":
                inner = f"<h3>{said(words(1, 3, ''), False)}</h3>"
                for _ in range(pick.randint(1, 5)):
                    inner += f'<div class="comment"><b>{said(words(1, 2, ""), False)}</b><p>{said(words(4, 60), False)}</p></div>'
            elif kind == "footer":
                inner = f"<p>{said(pick.choice(['© ', 'Copyright ', '']) + words(2, 14), False)}</p>"
                inner = inner if pick.random() < 0.5 else inner[3:-4]
            else:
                inner = said(words(1, 25, pick.choice(["", ".", "!"])), False)
                inner = inner if pick.random() < 0.4 else f"<p>{inner}</p>"
                if pick.random() < 0.3:
                    inner = f"<h4>{said(words(1, 4, ''), False)}</h4>" + inner
            return f"<{tag}{named}>{inner}</{tag}>"

        def content() -> str:
            kind = pick.random()
            if kind < 0.66:
                text = said(words(*pick.choice([(1, 6), (3, 12), (8, 90), (8, 90)])), True)
                return pick.choice(["<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<p>{}</p>", "<div>{}</div>"]).format(text)
            if kind < 0.8:
                level = pick.choice("234")
                return f"<h{level}>{said(words(1, 8, ''), True)}</h{level}>"
            if kind < 0.9:
                return "<ul>" + "".join(f"<li>{said(words(2, 20, pick.choice(['', '.'])), True)}</li>" for _ in range(pick.randint(2, 5))) + "</ul>"
            return pick.choice(["<blockquote>{}</blockquote>", "<pre>{}</pre>", "<figcaption>{}</figcaption>", "<td>{}</td>"]).format(
                said(words(4, 40), True)
            )

        before = [boiler(k) for k in ("header", "nav", "notice", "ad", "aside") if pick.random() < 0.5]
        after = [boiler(k) for k in ("comments", "aside", "share", "form", "ad", "nav", "notice", "footer") if pick.random() < 0.5]
        pick.shuffle(before)
        title = said(words(2, 12, pick.choice(["", "."])), True)
        head = f"<h1>{title}</h1>" if pick.random() < 0.8 else f"<header><h1>{title}</h1></header>"
        middle = [content() for _ in range(pick.randint(1, 14))]
        for kind in ("ad", "share", "aside", "form", "notice"):
            if pick.random() < 0.15:
                middle.insert(pick.randint(0, len(middle)), boiler(kind))
        if pick.random() < 0.15:
            middle.append(boiler("comments"))
        outer = pick.choice(["article", "article", "main", "div", "div", "section"])
        named = name("content") if outer in ("div", "section") or pick.random() < 0.3 else ""
        page = "".join(before) + f"<{outer}{named}>{head}{''.join(middle)}</{outer}>" + "".join(after)
        if pick.random() < 0.3:
            page = f"<div{pick.choice(['', name('content')])}>{page}</div>"
        found = [b for b in blocks(f"<html><body>{page}</body></html>") if b.text in truth]
        yield described(found), [truth[b.text] for b in found]


def train(count: int = PAGES) -> Field:
    """A field trained on composed pages; their number is fixed and does not grow with the input."""
    return fit(labelled_pages(count))


def main_text(html: str, field: Field, known: dict | None = None) -> str:
    page = blocks(html, known)
    return "\n\n".join(b.text for b, inside in zip(page, field.decode(described(page))) if inside)


def extract(pages: DataFrame, field: Field, html_col: str = "html", name: str = "text") -> DataFrame:
    """All rows and columns, and the main text of each whole page as ``name``: its blocks in
    order, joined by an empty line. Null and empty pages, and pages without main text, give an
    empty text. A column of that name is replaced."""
    pages = pages.drop(name)
    at = pages.columns.index(html_col)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            texts = [main_text(h or "", field, known) for h in batch.column(at).cast(pa.string()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return pages.mapInArrow(extracted, StructType([*pages.schema.fields, StructField(name, StringType())]))
