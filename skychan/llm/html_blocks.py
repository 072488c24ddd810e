"""Blocks of an HTML page, with what the page's structure says about each."""
from __future__ import annotations

import html
import re

# Element names of HTML and usual names in classes and ids.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their text is not markup.
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Never main text.
DROPPED_TAGS = frozenset("head script style noscript template title nav footer aside form button select textarea option svg math iframe object canvas audio video dialog menu xmp noembed noframes".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CUES = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored promo promotion promotions banner "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs masthead topbar header footer sidebar aside rail widget widgets "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "search searchbox share sharing social related recommended recommendations comment comments commentlist commentform disqus replies "
    "reply respond form pagination pager toolbar copyright disclaimer hidden".split())
#: A class that begins so says that something else is there, not what this is.
NOT_ITSELF = frozenset("has with no without is not".split())
COMMENT_CUES = frozenset("comment comments commentlist disqus reply replies".split())
#: An open element that one of these begins within it ends.
CLOSED_BY = {"p": BLOCK_TAGS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"},
             "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "option": {"option", "optgroup"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(r"""<!--|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_NAME = re.compile(r"[a-z0-9]+")

#: What a block is: main text by its place, to be dropped by its place, or neither.
MAIN, DROP, OPEN = 1, 2, 0


def _says(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element's own marks say that it is not main text."""
    if tag in DROPPED_TAGS or (tag == "header" and not in_article):
        return True
    if not attributes.strip():
        return False
    got = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in got or got.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", got.get("style", ""), re.I):
        return True
    if got.get("role", "").lower() in DROPPED_ROLES:
        return True
    if tag in ("html", "body", "main") or tag in HEADINGS:
        return False
    cues = COMMENT_CUES if tag == "article" else CUES
    for name in (got.get("class", "") + " " + got.get("id", "")).split():
        words = _NAME.findall(re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", name).lower())
        if words and words[0] not in NOT_ITSELF and not cues.isdisjoint(words):
            return True
    return False


def blocks(page: str) -> list[tuple[str, int]]:
    """Texts of the page's blocks in order, white space as one space, and what each is (MAIN, DROP or OPEN).

    Where a page has an article or main element, what lies in it and in no dropped element is main
    and the rest is dropped or open; without one all that is not dropped is open. An element that
    holds an article is never dropped for its class.
    """
    out: list[tuple[list[int], list[str]]] = []  # elements that are marked and open, words
    text: list[str] = []
    stack: list[tuple[str, int]] = []  # name, mark or -1
    marks: list[bool] = []  # by mark: article holder (True) or to be dropped (False)
    holds: list[bool] = []  # by mark: whether an article lies within
    hard: list[bool] = []

    def flush() -> None:
        if text:
            words = html.unescape("".join(text)).split()
            text.clear()
            if words:
                out.append(([m for _, m in stack if m >= 0], words))

    def leave(n: int) -> None:
        del stack[n:]

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at:m.start()])
        at = m.end()
        if m[0] == "<!--":
            stop = page.find("-->", at)
            at = end if stop < 0 else stop + 3
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                text.append(" ")
            found = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if tag in BLOCK_TAGS or (found >= 0 and any(t in BLOCK_TAGS or t in DROPPED_TAGS for t, _ in stack[found:])):
                flush()
            if found >= 0:
                leave(found)
            continue
        if tag in ("br", "td", "th", "img", "wbr"):
            text.append(" " if tag != "wbr" else "")
        if tag in BLOCK_TAGS or tag in DROPPED_TAGS:
            flush()
        for i in range(len(stack) - 1, -1, -1):
            name = stack[i][0]
            if tag in CLOSED_BY.get(name, ()):
                if name in BLOCK_TAGS:
                    flush()
                leave(i)
                break
            if name in BLOCK_TAGS and name not in CLOSED_BY or name in ("table", "ul", "ol", "dl"):
                break
        in_article = any(m_ >= 0 and marks[m_] for _, m_ in stack)
        mark = -1
        if _says(tag, m[3], in_article):
            mark = len(marks)
            marks.append(False)
            holds.append(False)
            hard.append(tag in DROPPED_TAGS)
        elif tag in ("article", "main"):
            for _, m_ in stack:
                if m_ >= 0:
                    holds[m_] = True
            mark = len(marks)
            marks.append(True)
            holds.append(False)
            hard.append(False)
        if tag in RAW_TAGS:
            stop = re.compile(f"</{re.escape(tag)}\\b", re.I).search(page, at)
            at = end if not stop else stop.start()
            if tag in ("script", "style", "iframe"):
                if stop:
                    close = page.find(">", at)
                    at = end if close < 0 else close + 1
                continue
        if tag not in VOID_TAGS and not m[3].rstrip().endswith("/") or tag in ("p", "div"):
            stack.append((tag, mark))
        elif mark >= 0:
            marks[mark] = False
    flush()
    kinds = []
    some = any(marks[m] and not holds[m] for m in range(len(marks)))
    for open_marks, _ in out:
        dropped = any(not marks[m] and (hard[m] or not holds[m]) for m in open_marks)
        main = some and any(marks[m] for m in open_marks)
        kinds.append(DROP if dropped else MAIN if main else OPEN)
    if MAIN in kinds:  # what is outside of an article that has text is not the article
        kinds = [DROP if k == OPEN else k for k in kinds]
    return [(" ".join(w), k) for (_, w), k in zip(out, kinds, strict=True)]
