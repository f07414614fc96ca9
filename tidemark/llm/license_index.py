"""License scan with a positional rare-token index.

Templates are licence notices; each has a label, its indexed words with their positions, and key phrases of which
one must stand in it. Every text is read once: its words are counted, and it keeps its different licence words, from which document
frequencies over the whole corpus give each licence word an IDF. A text with any anchor word (each key phrase
has one, so a text without cannot match) also keeps the places of its licence words.

A file is looked up by its highest-IDF licence words: all but the commonest `least - 1`, since a match has at least `least` different
words, in an index from each word to the templates for which it is rare. A template of n words that needs m of them is entered under its
n - m + 1 rarest: no m words of it avoid these all. So the lookup loses no match, whatever words were edited. The postings of the
templates found are intersected by relative position: each licence word at place i that a template has at position p
votes for the template to start at i - p. Starts that lie at most `slack` places behind another are one band, so that words put in or left
out (a comment sign on each line) only spread the votes; in a band each position of the template and each place of the text
counts once. A band with `share` of the template's indexed words, rounded up, is a match if a key phrase stands as a
whole within it. Phrases are templates too, of all their words in one start.

Only DataFrame functions are used; nothing is shuffled but one count per licence word.

Defined cases: a null or empty text has 0 words, no place, no label, score 0; a text of any length is read whole; of overlapping bands
of a template with equal votes the first is reported;
repeated rows are judged alike; other columns are neither read nor returned; an empty table gives an empty result
(with IDF of 0 for all words).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .native import let

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The word class before lower-casing.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Words that are not indexed, since they place nothing.
FUNCTION_WORDS = frozenset("a an and any are be for from in is it of on or the this to with you".split())

#: Openings of common licence notices, with label and key phrases.
NOTICES = [
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    # later parts of the same texts
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ["gnu general public license"]),
    ("gpl", "you should have received a copy of the gnu general public license along with this program if not see", ["gnu general public license"]),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library", ["gnu lesser general public license"]),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program", ["gnu affero general public license"]),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ["except in compliance"]),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", ["required by applicable law"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["this permission notice shall be included"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code must retain"]),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions in binary form must reproduce"]),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies", ["this permission notice appear"]),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at", ["mpl was not distributed"]),
]
ANCHORS = ("license", "cc", "permission", "redistribution", "redistributions", "creative", "unencumbered", "mpl", "compliance", "applicable")
SHARE, SLACK = 0.75, 8
_SPAN, _BACK = 1 << 40, 1 << 12


@dataclass(frozen=True)
class Template:
    label: str
    length: int
    #: position and word of every indexed word
    words: tuple[tuple[int, str], ...]
    needed: int
    #: numbers of the phrase templates of which one must stand within; empty for phrases
    keys: tuple[int, ...]


def templates(phrases: dict[str, str], notices: list, share: float) -> list[Template]:
    """Phrases first: those of the caller, then key phrases that are none of them."""
    texts = [*phrases, *dict.fromkeys(k for _, _, keys in notices for k in keys if k not in phrases)]
    out = []
    for text in texts:
        words = tuple(enumerate(text.split()))
        if not any(w in ANCHORS for _, w in words):
            raise ValueError(f"the key phrase has no anchor word: {text}")
        out.append(Template(phrases.get(text, ""), len(words), words, len(words), ()))
    for label, text, keys in notices:
        words = tuple((i, w) for i, w in enumerate(text.split()) if w not in FUNCTION_WORDS)
        out.append(Template(label, len(text.split()), words, math.ceil(share * len(words)), tuple(texts.index(k) for k in keys)))
    return out


def distinct_needed(t: Template) -> int:
    """Different words, at least, among any `needed` places of a template: those that fill most places first."""
    words = [w for _, w in t.words]
    left, out = t.needed, 0
    for n in sorted((words.count(w) for w in set(words)), reverse=True):
        if left <= 0:
            break
        left, out = left - n, out + 1
    return out


def places(docs: DataFrame, vocabulary: set[str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, own (the different licence words) and, for texts with an anchor word, hits: the places (i) of licence words (w)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    lowered = F.translate(text, capitals, small)
    # between gaps stand words; only the first and last piece can be empty, and a text of one gap has both
    n_words = lambda p: (F.size(p) - (F.element_at(p, 1) == "").cast("int") - ((F.element_at(p, -1) == "") & (F.size(p) > 1)).cast("int")).cast("long")
    known = F.array(*map(F.lit, sorted(vocabulary)))
    read = let(F.split(lowered, GAP, -1), lambda p: F.struct(n_words(p).alias("n_words"), F.array_intersect(p, known).alias("own")))
    words = F.regexp_extract_all(lowered, F.lit(f"({WORD})"), F.lit(1))
    hits = F.filter(F.transform(words, lambda w, i: F.struct(i.cast("long").alias("i"), w.alias("w"))), lambda h: h["w"].isin(sorted(vocabulary)))
    other = r"[0-9A-Za-z\x80-\x{10FFFF}]"
    anchored = text.rlike(f"(?i)(?<!{other})(?:{'|'.join(ANCHORS)})(?!{other})")
    none = F.array().cast("array<struct<i:bigint,w:string>>")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), read.alias("read"), F.when(anchored, hits).otherwise(none).alias("hits")).select("doc_id", "read.n_words", "read.own", "hits")


def idf(found: DataFrame, vocabulary: set[str]) -> dict[str, float]:
    """ln((1 + documents) / (1 + documents with the word)) over the whole corpus: a number for each word of the vocabulary."""
    docs = found.count()
    seen = found.select(F.explode("own").alias("w")).groupBy("w").count().collect()
    own = {r["w"]: r["count"] for r in seen}
    return {w: math.log((1 + docs) / (1 + own.get(w, 0))) for w in vocabulary}


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: list = NOTICES, share: float = SHARE, slack: int = SLACK) -> DataFrame:
    """doc_id, n_words, matches (label, start, votes, of, base, phrase) of every text: whole phrases, and notices whose key phrase stands."""
    known = templates(phrases, notices, share)
    vocabulary = {w for t in known for _, w in t.words}
    found = stored(places(docs, vocabulary, id_col=id_col, text_col=text_col), "license-places")
    weight = idf(found, vocabulary)

    # words by falling IDF; the number of a word is its rank there
    ranked = sorted(vocabulary, key=lambda w: (-weight[w], w))
    rank = {w: i for i, w in enumerate(ranked)}
    postings: list[list[tuple[int, int]]] = [[] for _ in ranked]
    rare_of: list[list[int]] = [[] for _ in ranked]
    for n, t in enumerate(known):
        for p, w in t.words:
            postings[rank[w]].append((n, p))
        for w in sorted({w for _, w in sorted(t.words, key=lambda x: rank[x[1]])[: len(t.words) - t.needed + 1]}):
            rare_of[rank[w]].append(n)
    # different words that any match has
    least = min(distinct_needed(t) for t in known)

    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs)) if xs else F.array().cast("array<bigint>")
    ranks = F.create_map(*(x for w, i in rank.items() for x in (F.lit(w), F.lit(i))))
    looked = F.array(*(longs(ns) for ns in rare_of))
    # a posting is template, position and template * _SPAN - position, so that adding the place gives template * _SPAN + start
    posted = F.array(*(F.array(*(F.struct(F.lit(n).cast("long").alias("t"), F.lit(p).cast("long").alias("p")) for n, p in ps)) for ps in postings))
    needed, length, of = longs([t.needed for t in known]), longs([t.length for t in known]), longs([len(t.words) for t in known])
    band = longs([slack if t.keys else 0 for t in known])
    window = longs([(slack + 1) * len(t.words) if t.keys else len(t.words) for t in known])
    label = F.array(*(F.lit(t.label) for t in known))
    keys = F.array(*(longs(t.keys) for t in known))
    none = F.array().cast("array<struct<t:bigint,start:bigint,votes:bigint>>")
    at = lambda table, t: F.get(table, t.cast("int"))

    def allowed(hits: Column) -> Column:
        own = F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["w"])))
        return let(own, lambda ws: F.array_distinct(F.flatten(F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - (least - 1), F.lit(0))), lambda w: F.get(looked, w)))))

    def votes(hits: Column, ts: Column) -> Column:
        of_hit = lambda h: F.transform(F.filter(F.get(posted, h["w"]), lambda x: F.array_contains(ts, x["t"])), lambda x: F.struct((x["t"] * _SPAN + _BACK - x["p"] + h["i"]).alias("code"), x["p"].alias("p"), h["i"].alias("i")))
        return F.array_sort(F.flatten(F.transform(hits, of_hit)))

    def counted(vs: Column) -> Column:
        """For each start from which a band has enough votes: the template, the start and the votes."""
        code = lambda j: F.get(vs, j)["code"]
        t_of = lambda j: F.floor(code(j) / F.lit(_SPAN))
        begins = F.filter(F.sequence(F.lit(0), F.size(vs) - 1), lambda j: ((j == 0) | (code(j) != code(j - 1))) & (code(j + at(needed, t_of(j)).cast("int") - 1) <= code(j) + at(band, t_of(j))))
        inside = lambda j: F.filter(F.slice(vs, j + 1, at(window, t_of(j)).cast("int")), lambda v: v["code"] <= code(j) + at(band, t_of(j)))
        once = lambda xs, c: F.size(F.array_distinct(F.transform(xs, lambda v: v[c])))
        number = lambda j: let(inside(j), lambda xs: F.least(once(xs, "p"), once(xs, "i")).cast("long"))
        bands = F.transform(begins, lambda j: F.struct(t_of(j).alias("t"), (code(j) % F.lit(_SPAN) - _BACK).alias("start"), number(j).alias("votes")))
        return F.when(F.size(vs) == 0, none).otherwise(F.filter(bands, lambda b: b["votes"] >= at(needed, b["t"])))

    def best(bands: Column) -> Column:
        """Of neighbours that overlap, those that no neighbour exceeds."""
        beside = lambda a, b: F.coalesce((a["t"] == b["t"]) & (F.abs(a["start"] - b["start"]) <= at(band, b["t"])), F.lit(False))
        beaten = lambda b, j: (beside(F.get(bands, j - 1), b) & (F.get(bands, j - 1)["votes"] >= b["votes"])) | (beside(F.get(bands, j + 1), b) & (F.get(bands, j + 1)["votes"] > b["votes"]))
        return F.filter(bands, lambda b, j: ~beaten(b, j))

    def verified(bands: Column) -> Column:
        is_phrase = lambda b: F.size(at(keys, b["t"])) == 0
        within = lambda b, ps: F.exists(ps, lambda p: F.array_contains(at(keys, b["t"]), p["t"]) & (p["start"] >= b["start"]) & (p["start"] < b["start"] + at(length, b["t"]) + at(band, b["t"])))
        return let(F.filter(bands, is_phrase), lambda ps: F.filter(bands, lambda b: is_phrase(b) | within(b, ps)))

    def shown(b: Column) -> Column:
        t = b["t"]
        return F.struct(at(label, t).alias("label"), F.greatest(b["start"], F.lit(0)).alias("start"), b["votes"].alias("votes"), at(of, t).alias("of"), (t < len(phrases)).alias("base"), (F.size(at(keys, t)) == 0).alias("phrase"))

    hits = F.transform("hits", lambda h: F.struct(h["i"].alias("i"), ranks[h["w"]].alias("w")))
    matched = let(hits, lambda hs: let(allowed(hs), lambda ts: let(votes(hs, ts), lambda vs: let(counted(vs), lambda bs: let(verified(bs), best)))))
    return found.select("doc_id", "n_words", F.transform(F.when(F.size("hits") > 0, matched).otherwise(none), shown).alias("matches"))


def summary(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score.

    score is the largest share of a notice's indexed words that stand in place, or 0.5 for a text with a base phrase and
    no notice.
    """
    base = F.filter("matches", lambda m: m["base"])
    notice = F.filter("matches", lambda m: ~m["phrase"])
    names = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["start"])
    score = F.greatest(F.coalesce(F.array_max(F.transform(notice, lambda m: m["votes"] / m["of"])), F.lit(0.0)), F.when(F.size(base) > 0, 0.5).otherwise(0.0))
    return scanned.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.filter("matches", lambda m: m["base"] | ~m["phrase"])).alias("labels"), F.least(score, F.lit(1.0)).alias("score"))
