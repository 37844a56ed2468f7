"""HTML as records, by the standard parser inside Arrow batches: one walk over a page gives all of them."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.markup import Markup, spaced

SKIPPED = frozenset(("script", "style", "noscript"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# fixed values: where notices stand: kinds of elements, and words of classes and ids, in the order in which they are looked for
PLACES = [
    ("footer", "footer"), (None, "contact"), (None, "inquiry"), (None, "policy"), (None, "terms"), (None, "legal"), ("form", "form"), ("nav", "nav"), ("aside", "side"), (None, "notice"), (None, "warning"),
    (None, "alert"),
]
HEADED = ("h1", "h2", "h3", "h4", "h5", "h6", "li")
LEAST_TEXT = 10
#: Icons of this class label the value in the box around them.
ICON_CLASS, BOX_CLASS = "material-icons", "md:w-[50%]"
PAGE = (
    "text string, targeted string, links array<struct<href:string,text:string>>, labels array<struct<for:string,text:string>>, icons array<struct<icon:string,value:string>>, "
    "forms array<struct<action:string,method:string,inputs:array<struct<tag:string,type:string,name:string,id:string,placeholder:string,required:boolean>>,"
    "buttons:array<struct<type:string,text:string>>,text:string>>, signals struct<script:boolean,frame:boolean,anchor:boolean,field:boolean,badge:boolean,sitekey:boolean,challenge:boolean>"
)


def _selectors(tag: str, classes: str, ident: str) -> list[int]:
    """The numbers of the places that an element is: by kind, class and id each once, so that one with several is there several times."""
    out, k = [], 0
    for kind, word in PLACES:
        for hit in ((tag == kind,) if kind else ()) + (word in classes, word in ident):
            if hit:
                out.append(k)
            k += 1
    return out + ([k + HEADED.index(tag)] if tag in HEADED else [])


class _Reader(Markup):
    """Collects text, links, forms, labels, labelled values and signs of bot checks."""

    def __init__(self):
        super().__init__()
        self.skip, self.words, self.forms, self.open, self.links, self.anchor, self.button = 0, [], [], None, [], None, None
        self.labels, self.label, self.stack, self.places, self.icons = [], None, [], [], []
        self.opened: Counter = Counter()
        self.signals = dict.fromkeys(("script", "frame", "anchor", "field", "badge", "sitekey", "challenge"), False)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        classes, ident = a.get("class", ""), a.get("id", "")
        self._signs(tag, a, classes, ident)
        if tag in SKIPPED:
            self.skip += 1
        elif tag == "form":
            self.open = {"action": a.get("action"), "method": a.get("method", "get").lower(), "inputs": [], "buttons": [], "words": []}
            self.forms.append(self.open)
        elif tag == "a":
            self.anchor = [a.get("href"), []]
            self.links.append(self.anchor)
        elif tag == "label":
            self.label = [a.get("for"), []]
            self.labels.append(self.label)
        elif self.open is not None and tag in ("input", "textarea", "select"):
            kind = a.get("type", "text").lower() if tag == "input" else tag
            if kind in ("submit", "image", "button"):
                self.open["buttons"].append({"type": kind, "text": a.get("value", "")})
            else:
                self.open["inputs"].append({"tag": tag, "type": kind, "name": a.get("name"), "id": a.get("id"), "placeholder": a.get("placeholder"), "required": "required" in a})
                if self.label is not None and self.label[0] is None:
                    self.label[0] = a.get("id") or a.get("name")  # a label around its field
        elif self.open is not None and tag == "button":
            self.button = {"type": a.get("type", "submit").lower(), "text": ""}
            self.open["buttons"].append(self.button)
        if tag not in VOID:
            one = {"tag": tag, "from": len(self.words), "places": _selectors(tag, classes, ident), "at": len(self.stack), "box": tag == "div" and BOX_CLASS in classes, "icon": tag == "i" and ICON_CLASS in classes.split(), "lines": [], "named": None, "has_icon": False}
            self.stack.append(one)
            self.opened[tag] += 1

    def _signs(self, tag, a, classes, ident):
        src, s = a.get("src", ""), self.signals
        s["script"] |= tag == "script" and "recaptcha/api.js" in src
        s["frame"] |= tag == "iframe" and "recaptcha" in src
        s["anchor"] |= tag == "iframe" and "recaptcha/api2/anchor" in src
        s["field"] |= a.get("name") == "g-recaptcha-response"
        names = classes.split()
        s["badge"] |= "grecaptcha-badge" in names or "g-recaptcha" in names
        s["sitekey"] |= "g-recaptcha" in names and "data-sitekey" in a
        s["challenge"] |= "cf-browser-verification" in names or ident == "cf-wrapper"

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "form":
            self.open = None
        elif tag == "a":
            self.anchor = None
        elif tag == "button":
            self.button = None
        elif tag == "label":
            self.label = None
        if self.opened[tag]:  # a tag that closes nothing is stray
            while self.stack:
                if self._leave(self.stack.pop()) == tag:
                    break

    def _leave(self, e):
        self.opened[e["tag"]] -= 1
        text = self.words[e["from"] :] if e["places"] or e["icon"] or e["tag"] == "p" or e["box"] else ()
        if e["places"] and len(joined := " ".join(text)) >= LEAST_TEXT:
            self.places += [(k, e["from"], e["at"], joined) for k in e["places"]]
        if e["icon"]:
            for up in self.stack:
                up["has_icon"] = True
            box = next((u for u in reversed(self.stack) if u["box"]), None)
            if box is not None and box["named"] is None:
                box["named"] = " ".join(text)
        if e["tag"] == "p" and not e["has_icon"]:
            box = next((u for u in reversed(self.stack) if u["box"]), None)
            if box is not None:
                box["lines"].append("".join(text))
        if e["box"] and e["named"] is not None:
            value = next((x for x in e["lines"] if x not in ("", "-", "ー", "－", e["named"])), None)
            self.icons.append({"icon": e["named"], "value": value})
        return e["tag"]

    def close(self):
        super().close()
        while self.stack:
            self._leave(self.stack.pop())

    def handle_data(self, data):
        if self.skip or not (words := spaced(data)):
            return
        self.words.append(words)
        if self.open is not None:
            self.open["words"].append(words)
        if self.anchor is not None:
            self.anchor[1].append(words)
        if self.label is not None:
            self.label[1].append(words)
        if self.button is not None:
            self.button["text"] = f"{self.button['text']} {words}".strip()


def read(page: str | None) -> tuple:
    """The record of a page, as PAGE has it."""
    r = _Reader.read(page)
    forms = [{**{k: f[k] for k in ("action", "method", "inputs", "buttons")}, "text": " ".join(f["words"])} for f in r.forms]
    links = [{"href": h, "text": " ".join(t)} for h, t in r.links]
    labels = [{"for": f, "text": " ".join(t)} for f, t in r.labels if f]
    return " ".join(r.words), " ".join(p[3] for p in sorted(r.places)), links, labels, r.icons, forms, r.signals


def page(c: Column) -> Column:
    """A struct with all text, the text of telling places, links, labels, labelled values, forms, and signs of bot checks."""
    names = [re.match(r"\w+", f)[0] for f in re.split(r", (?=\w+ (?:string|array|struct))", PAGE)]

    @F.pandas_udf(PAGE)
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(p) for p in pages], columns=names)

    return run(c)


class _Words(Markup):
    """Text and anchors only."""

    def __init__(self):
        super().__init__()
        self.skip, self.words, self.anchors, self.anchor, self.open = 0, [], [], None, []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        elif tag == "a":
            a = dict(attrs)
            parent = self.open[-1] if self.open else (None, None)
            self.anchor = [a.get("href"), [], a.get("title"), a.get("aria-label"), [], a.get("id"), a.get("class"), *parent]
            self.anchors.append(self.anchor)
        elif tag == "img" and self.anchor is not None and (alt := dict(attrs).get("alt")):
            self.anchor[4].append(alt)
        if tag not in VOID:
            self.open.append((tag, dict(attrs).get("class")))

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "a":
            self.anchor = None
        # a tag left open inside this one ends with it; far ones are looked for only if the last does not fit
        if self.open and self.open[-1][0] == tag:
            self.open.pop()
        elif any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if self.skip or not (words := spaced(data)):
            return
        self.words.append(words)
        if self.anchor is not None:
            self.anchor[1].append(words)


def _read(page: str | None) -> _Words:
    return _Words.read(page)


def page_text(c: Column) -> Column:
    """All text but that of scripts and styles, joined by spaces."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([" ".join(_read(p).words) for p in pages], dtype="object")

    return run(c)


class _Forms(Markup):
    """Forms only, as ``_Reader`` has them."""

    def __init__(self):
        super().__init__()
        self.skip, self.forms, self.open, self.button = 0, [], None, None

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        elif tag == "form":
            a = {k: v or "" for k, v in attrs}
            self.open = {"action": a.get("action"), "method": a.get("method", "get").lower(), "inputs": [], "buttons": [], "words": []}
            self.forms.append(self.open)
        elif self.open is None:
            return
        elif tag in ("input", "textarea", "select"):
            a = {k: v or "" for k, v in attrs}
            kind = a.get("type", "text").lower() if tag == "input" else tag
            if kind in ("submit", "image", "button"):
                self.open["buttons"].append({"type": kind, "text": a.get("value", "")})
            else:
                self.open["inputs"].append({"tag": tag, "type": kind, "name": a.get("name"), "id": a.get("id"), "placeholder": a.get("placeholder"), "required": "required" in a})
        elif tag == "button":
            self.button = {"type": (dict(attrs).get("type", "submit") or "").lower(), "text": ""}
            self.open["buttons"].append(self.button)

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "form":
            self.open = None
        elif tag == "button":
            self.button = None

    def handle_data(self, data):
        if (self.open is None and self.button is None) or self.skip or not (words := spaced(data)):
            return
        if self.open is not None:
            self.open["words"].append(words)
        if self.button is not None:
            self.button["text"] = f"{self.button['text']} {words}".strip()


FORM = re.search(r"forms (array<.*>), signals", PAGE)[1]
_INPUT = pa.struct([("tag", pa.string()), ("type", pa.string()), ("name", pa.string()), ("id", pa.string()), ("placeholder", pa.string()), ("required", pa.bool_())])
_BUTTON = pa.struct([("type", pa.string()), ("text", pa.string())])
_FORM = pa.struct([("action", pa.string()), ("method", pa.string()), ("inputs", pa.list_(_INPUT)), ("buttons", pa.list_(_BUTTON)), ("text", pa.string())])


def forms(c: Column) -> Column:
    """The forms of a page with their inputs, buttons and text."""

    @F.arrow_udf(FORM)
    def run(pages: pa.Array) -> pa.Array:
        # page by page: only the forms are held, not the pages as strings
        made = ([{**{k: f[k] for k in ("action", "method", "inputs", "buttons")}, "text": " ".join(f["words"])} for f in _Forms.read(p.as_py()).forms] for p in pages)
        return pa.array(made, pa.list_(_FORM))

    return run(c)


ANCHOR = "struct<href:string,text:string,title:string,aria:string,alt:string,id:string,classes:string,parent:string,parent_classes:string>"


def anchors(c: Column) -> Column:
    """array of ``ANCHOR``: the anchors in page order, with their attributes, the texts of their pictures, and the element around them."""

    @F.pandas_udf(f"array<{ANCHOR}>")
    def run(pages: pd.Series) -> pd.Series:
        made = []
        for p in pages:
            found = _read(p).anchors
            made.append([
                {"href": href, "text": " ".join(words), "title": title, "aria": aria, "alt": " ".join(alts) or None, "id": ident, "classes": classes, "parent": parent, "parent_classes": around}
                for href, words, title, aria, alts, ident, classes, parent, around in found
            ])
        return pd.Series(made, dtype="object")

    return run(c)


_LINK = pa.struct([("href", pa.string()), ("text", pa.string())])


def links(c: Column) -> Column:
    """array<struct<href, text>> of the anchors in page order."""

    @F.arrow_udf("array<struct<href:string,text:string>>")
    def run(pages: pa.Array) -> pa.Array:
        # page by page: a batch of pages is held once, as it came
        return pa.array(([{"href": a[0], "text": " ".join(a[1])} for a in _Words.read(p.as_py()).anchors] for p in pages), pa.list_(_LINK))

    return run(c)


def form_markup(c: Column) -> Column:
    """What stands inside the forms of a page, form after form, by lines."""
    return F.array_join(F.regexp_extract_all(c, F.lit(r"(?is)<form\b[^>]*>(.*?)(?:</form\s*>|\z)"), F.lit(1)), "\n")


def bot_check(signals: Column, title: Column, url: Column, text: Column) -> Column:
    """The name of the bot check that a page shows: a visible box with its frame, two signs of one, or a challenge page; else null."""
    n = sum((F.when(signals[k], 1).otherwise(0) for k in ("script", "frame", "field", "badge")), F.lit(0))
    box = signals["anchor"] & signals["sitekey"]
    challenge = (
        url.contains("/cdn-cgi/challenge-platform/") & (title == "Just a moment...") & signals["challenge"] & text.contains("Cloudflare") & text.contains("Checking your browser")
    )
    return F.when(box | (n >= 2), "reCAPTCHA").when(challenge, "Cloudflare Challenge")
