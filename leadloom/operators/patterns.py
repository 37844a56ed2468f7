"""The catalogue of field words as one trie: each attribute is walked once, whatever the number of rules, and no rule meets an element that it does not fit."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame


class Word(NamedTuple):
    """A word that names a field, where it is looked for, and its weight."""

    field: str
    attribute: str
    word: str
    weight: int


# fixed values: words of fields by attribute: names and ids in Latin letters, labels and placeholders in Japanese
NAMES = {
    "company": "company corp organization", "full_name": "your-name fullname full_name", "last_name": "last_name sei family", "first_name": "first_name mei given", "kana": "kana furigana hiragana", "email": "email mail",
    "phone": "tel phone fax", "postal": "zip postal", "prefecture": "pref", "address": "addr address", "url": "url website", "subject": "subject title", "message": "message body inquiry content", "department": "department dept",
}
LABELS = {
    "company": "会社 企業 法人 company", "full_name": "お名前 氏名", "last_name": "姓 セイ", "first_name": "名 メイ", "kana": "フリガナ ふりがな", "email": "メール mail", "phone": "電話 tel", "postal": "郵便", "prefecture": "都道府県",
    "address": "住所", "url": "url ホームページ", "subject": "件名", "message": "お問い合わせ 本文 内容 ご意見 message", "department": "部署",
}
WEIGHTS = {"name": 60, "ident": 60, "placeholder": 40, "label": 80}
END = ""


def catalogue() -> list[Word]:
    """Every word of every field in every attribute that it is looked for in."""
    lists = {"name": NAMES, "ident": NAMES, "placeholder": LABELS, "label": LABELS}
    return [Word(field, attribute, w, WEIGHTS[attribute]) for attribute, words in lists.items() for field, ws in words.items() for w in ws.split()]


def trie(words: list[Word]) -> dict:
    """Nested dicts by character; END holds the rules whose word ends there."""
    root: dict = {}
    for one in words:
        at = root
        for ch in one.word.lower():
            at = at.setdefault(ch, {})
        at.setdefault(END, []).append(one)
    return root


def found(text: str, root: dict) -> set[Word]:
    """The words that occur in a text."""
    out: set[Word] = set()
    for start in range(len(text)):
        at, k = root, start
        while k < len(text) and (at := at.get(text[k])) is not None:
            out.update(at.get(END, ()))
            k += 1
    return out


def rule_hits(elements: DataFrame, keys: list[str], words: list[Word] | None = None) -> DataFrame:
    """keys, attribute, field, word, weight: a row for each word of the catalogue that an attribute of an element holds, without regard to case."""
    by: dict[str, list[Word]] = {}
    for w in catalogue() if words is None else words:
        by.setdefault(w.attribute, []).append(w)
    tries = {a: trie(ws) for a, ws in by.items()}
    schema = elements.select(*keys).schema.add("attribute", "string").add("field", "string").add("word", "string").add("weight", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hits = [], []
            for attribute, root in tries.items():
                for k, text in enumerate(batch.column(attribute).to_pylist()):
                    for w in sorted(found((text or "").lower(), root)):
                        rows.append(k)
                        hits.append(w)
            if rows:
                at = pa.array(rows, pa.int64())
                held = [batch.column(c).take(at) for c in keys]
                new = [pa.array([w.attribute for w in hits]), pa.array([w.field for w in hits]), pa.array([w.word for w in hits]), pa.array([w.weight for w in hits], pa.int32())]
                yield pa.RecordBatch.from_arrays([*held, *new], names=[*keys, "attribute", "field", "word", "weight"])

    return elements.select(*keys, *tries).mapInArrow(run, schema)
