"""Personal data: fixed patterns, and terms that reveal them by information-theoretic sanitisation.

The protected entities are the values that the patterns find. A term t in the window of an entity e
discloses PMI(e; t) = log2(n_et * N / (n_e * n_t)) bits of the IC(e) = log2(N / n_e) bits that name e
(Sanchez and Batet, 2013), with n counted in documents of the whole corpus: n_et those in which t is in a
window of e, n_e and n_t those that hold e, or t anywhere. A copy of a document adds as much to n_et as to
n_e and n_t, so copies neither raise nor hide a share. One meeting proves nothing (any word that no other
document has would disclose all), so a pair counts from SUPPORT mentions of the term on, in one text that has
it near e, or in several different ones.

A term whose share PMI / IC reaches DISCLOSES is generalised in the documents that hold e beside it: to the
longest of its beginnings whose own share is below DISCLOSES. A beginning stands for all words of the corpus
that begin so: n_ep documents hold one of them in a window of e, and anywhere at least as many (n_p) as hold the
most frequent one, so that its share is never understated and what is coarse enough follows from the corpus. A
term without such a beginning is removed.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, materialize, scan_texts, table, text_of, unused

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "term")
#: Terms on each side of an entity, the share of disclosure, and the mentions that must show it.
WINDOW, DISCLOSES, SUPPORT = 12, 0.9, 2
#: Characters of the longest beginning that a term is generalised to.
LONGEST_COARSE = 16
#: Different terms that a task counts before it passes them on.
COUNTED_TERMS = 200_000
#: Bytes of found terms that are broadcast to their texts; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that starts inside a run of digits would start at the run, so that only runs are tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MAYBE = re.compile(rb"[0-9@]")
#: Scripts written without spaces (Han and kana): each two characters in a row are a term.
_DENSE = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_IN_DENSE = re.compile(rf"[{_DENSE}]")
_RUN, _TERM = re.compile(r"[^\W_]+"), re.compile(rf"[{_DENSE}]+|[^\W_{_DENSE}]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From one @ to the next: the local part is the whole run before it, so long runs cost nothing."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def entity(kind: str, value: str) -> str:
    """The protected value behind a span, without its spelling."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else ''.join(c for c in value if c.isdigit())}"


def terms_of(text: str) -> Iterator[tuple[int, int]]:
    """Places of the terms: runs of letters and digits of any script and length, codes too; of runs of a script
    without spaces every two characters."""
    if text.isascii() or not _IN_DENSE.search(text):
        yield from (m.span() for m in _RUN.finditer(text))
        return
    for m in _TERM.finditer(text):
        start, end = m.span()
        if end - start > 2 and _IN_DENSE.match(text, start):
            yield from ((k, k + 2) for k in range(start, end - 1))
        else:
            yield start, end


def _free_terms(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, str]]:
    """Terms of the text (in lower case, with their places) that overlap no span (given by start), in one
    sweep along both."""
    covered: list[list[int]] = []
    for _, start, end in spans:
        if covered and start < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    out, k, n = [], 0, len(covered)
    for start, end in terms_of(text):
        while k < n and covered[k][1] <= start:
            k += 1
        if k == n or covered[k][0] >= end:
            out.append((start, end, text[start:end].lower()))
    return out


def _evidence(text: str, spans: list[tuple[str, int, int]]) -> dict[tuple[str, str], int]:
    """(entity, term) of the WINDOW terms before and after each entity, however far, and the mentions of the
    term in the text."""
    out: set[tuple[str, str]] = set()
    terms = _free_terms(text, spans)
    starts = [start for start, _, _ in terms]
    for kind, start, end in spans:
        name = entity(kind, text[start:end])
        at = bisect.bisect_left(starts, start)  # terms from here on are behind the span, as none overlaps it
        out.update((name, word) for _, _, word in terms[max(0, at - WINDOW) : at + WINDOW])
    mentions = Counter(word for _, _, word in terms) if out else {}
    return {pair: mentions[pair[1]] for pair in out}


def _begins(t, most):
    """Beginnings of the term t (a column), of 1 to `most` characters and LONGEST_COARSE at most."""
    most = F.least(most, F.lit(LONGEST_COARSE))
    each = F.transform(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda k: F.left(t, k))
    return F.when(most >= 1, each).otherwise(F.array().cast("array<string>"))


def _count_terms(df: DataFrame, text: str) -> DataFrame:
    """(t, n_t): documents that hold each term anywhere."""

    def start():
        def run(rows):
            count: Counter = Counter()
            for (x,) in rows:
                text = text_of(x)
                if text.isascii() or not _IN_DENSE.search(text):
                    count.update(set(map(str.lower, set(_RUN.findall(text)))))
                else:
                    count.update({text[a:b].lower() for a, b in terms_of(text)})
                if len(count) > COUNTED_TERMS:
                    yield from count.items()
                    count.clear()
            yield from count.items()

        return run

    out = T.StructType().add("t", "string").add("n", "long")
    return materialize(scan_texts(df, [text], out, start).groupBy("t").agg(F.sum("n").alias("n_t")))


#: Two hashes of a text, as by Spark: strangers that share one don't share the other.
_WHOLE = T.StructType().add("a", "long").add("b", "long")
_SECOND = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42)


def _whole_of(text):
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def _whole(x: bytes) -> tuple[int, int]:
    """The same of a text's bytes."""
    both = xxhash.xxh64_intdigest(x, 42), xxhash.xxh64_intdigest(x, _SECOND)
    return tuple(h - (1 << 64) if h >> 63 else h for h in both)


def _seen(df: DataFrame, text: str) -> DataFrame:
    """(whole, e, t, n, m): entities, and the terms in their windows (t empty for the entity itself), of each
    different text (by its hashes), how many documents have that text, and the term's mentions in it."""

    def start():
        def run(rows):
            for (x,) in rows:
                if x and _MAYBE.search(x):
                    text = text_of(x)
                    spans = base_spans(text)
                    if not spans:
                        continue
                    whole = _whole(x)
                    yield from ((whole, e, "", 0) for e in {entity(k, text[a:b]) for k, a, b in spans})
                    yield from ((whole, *pair, m) for pair, m in _evidence(text, spans).items())

        return run

    schema = T.StructType().add("whole", _WHOLE).add("e", "string").add("t", "string").add("m", "long")
    return materialize(scan_texts(df, [text], schema, start).groupBy("whole", "e", "t").agg(F.count(F.lit(1)).alias("n"), F.max("m").alias("m")))


def _share(near: str, n: float, everywhere: str):
    pmi = F.log2(F.col(near) * F.lit(n) / (F.col("n_e") * F.col(everywhere)))
    return F.when(F.col("n_e") < n, pmi / F.log2(F.lit(n) / F.col("n_e"))).otherwise(0.0)


def _disclosing(df: DataFrame, seen: DataFrame, text: str) -> DataFrame:
    n = float(df.count())
    of_entity = seen.where(F.col("t") == "").groupBy("e").agg(F.sum("n").alias("n_e"))
    near = seen.where(F.col("t") != "")
    pairs = near.groupBy("e", "t").agg(F.sum("n").alias("n_et"), F.sum("m").alias("m")).where(F.col("m") >= SUPPORT).drop("m")
    pairs = materialize(pairs.join(of_entity, "e"))
    counts = _count_terms(df, text)
    begins = _begins(F.col("t"), F.length("t") - 1)
    found = materialize(pairs.join(counts, "t").withColumn("share", _share("n_et", n, "n_t")).where(F.col("share") >= DISCLOSES))
    asked = found.select("e", "t", "n_e", F.posexplode(begins).alias("k", "p"))
    # of the entities of these terms: in how many documents words of a beginning are near
    own = near.join(found.select("e").distinct(), "e", "left_semi")
    own = own.select("whole", "e", "n", F.explode(_begins(F.col("t"), F.length("t"))).alias("p"))
    beside = own.join(asked.select("e", "p").distinct(), ["e", "p"], "left_semi").groupBy("whole", "e", "p").agg(F.max("n").alias("n"))
    beside = beside.groupBy("e", "p").agg(F.sum("n").alias("n_ep"))
    words = counts.select("n_t", F.explode(_begins(F.col("t"), F.length("t"))).alias("p"))
    words = words.join(asked.select("p").distinct(), "p", "left_semi").groupBy("p").agg(F.max("n_t").alias("n_p"))
    each = asked.join(beside, ["e", "p"]).join(words, "p")
    safe = each.where(_share("n_ep", n, "n_p") < DISCLOSES).groupBy("e", "t").agg(F.sum(F.pow(F.lit(2.0), F.col("k") + 1)).cast("long").alias("safe"))
    return found.join(safe, ["e", "t"], "left").select("e", "t", "share", F.coalesce("safe", F.lit(0).cast("long")).alias("safe"))


def disclosing_terms(df: DataFrame, text: str = "text") -> DataFrame:
    """(e, t, share, safe): entities of the corpus, the terms that disclose them, how much, from DISCLOSES on, and
    the lengths of beginnings that disclose less, as the bits of a number."""
    return _disclosing(df, _seen(df, text), text)


def _terms_of_texts(df: DataFrame, text: str) -> DataFrame:
    """(whole, terms): of each text, by its hashes, the terms that disclose its own entities, each with the
    largest share and the lengths of beginnings that disclose none of them."""
    seen = _seen(df, text)
    if seen.isEmpty():
        return seen.select("whole", F.array().cast("array<struct<t:string,share:double,safe:bigint>>").alias("terms"))
    found = seen.where(F.col("t") != "").join(_disclosing(df, seen, text), ["e", "t"])
    each = found.groupBy("whole", "t").agg(F.max("share").alias("share"), F.bit_and("safe").alias("safe"))
    # as many as a text has near its entities
    return materialize(each.groupBy("whole").agg(F.collect_list(F.struct("t", "share", "safe")).alias("terms")))


def coarser(term: str, safe: int) -> str | None:
    """The longest beginning of a safe length, with a star; None if there is none."""
    return f"{term[: safe.bit_length() - 1]}*" if safe else None


def _term_spans(text: str, terms: dict[str, tuple[float, int]], spans: list[tuple[str, int, int]]) -> list[tuple[int, int, float, str | None]]:
    return [(start, end, own[0], coarser(word, own[1])) for start, end, word in _free_terms(text, spans) if (own := terms.get(word))]


def _place(span: tuple) -> tuple:
    return span[1], ALL_KINDS.index(span[0]), span[2]


SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer").add("share", "double").add("coarse", "string"))


def find(df: DataFrame, keep: list[str], text: str = "text", clean: str | None = None, into: str = "spans") -> DataFrame:
    """Columns `keep` and `into`, spans of every whole text: kind, start, end (code points, end exclusive),
    and for the kind `term` share (of disclosure) and coarse (what it is generalised to, null if it is
    removed), by start, then kind (email, ip, card, phone, term).
    clean: name of a further column, the redacted text.

    A null text is the empty one and has no spans, and stays null redacted; bytes that aren't UTF-8 count
    as U+FFFD; repeated rows stay, and count as documents in the statistics; empty tables give no rows;
    other columns are ignored, and a kept column named as `into` or `clean` gives way.
    """
    found = _terms_of_texts(df, text)
    size = found.agg(F.sum(24 + F.aggregate("terms", F.lit(0), lambda n, x: n + F.octet_length(x["t"]) + 32))).first()[0] or 0
    whole, terms = unused(df.columns, "__whole"), unused(df.columns, "__terms")
    found = found.select(F.col("whole").alias(whole), F.col("terms").alias(terms))
    hashed = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])], _whole_of(F.col(f"`{text}`").cast("string")).alias(whole))
    rows = hashed.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, whole, "left")

    def start():
        def one(x, terms):
            t = text_of(x)
            spans = base_spans(t)
            more = _term_spans(t, {r["t"]: (r["share"], r["safe"]) for r in terms}, spans) if terms else []
            spans = sorted([*[(*s, None, None) for s in spans], *[("term", *s) for s in more]], key=_place)
            return (spans, None if x is None else redact(t, spans)) if clean else (spans,)

        return one

    out = T.StructType().add(into, SPANS)
    return map_texts(rows, text, keep, out.add(clean, "string") if clean else out, start, beside=(terms,))


def redact(text: str, spans: list) -> str:
    """The text with every value replaced by its kind, and every term by what it is generalised to, or
    left out. Spans that overlap become one, treated as the first."""
    out, done = [], 0
    for kind, start, end, _, coarse in spans:
        if start >= done:
            out += [text[done:start], coarse or "" if kind == "term" else f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redacted(df: DataFrame, text: str = "text") -> DataFrame:
    """df with every span of its texts redacted. Null texts stay null; columns stay as they are."""
    names = df.columns
    spans, clean = unused(names, "spans"), unused(names, "clean")
    own = F.col(clean).alias(text)
    return find(df, names, text, clean, spans).select(*[own if c == text else F.col(f"`{c}`") for c in names])


def op8_pii_disclosure(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), ["doc_id"])
    as_text = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"] != "term")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(F.array_join(F.transform(base, as_text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", as_text), ",").alias("spans"),
    )
