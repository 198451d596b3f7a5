"""Personal data by bootstrapped contextual extraction.

One scan finds the base entities (email, ip, card, phone) by fixed forms, in time linear in the
text, and beside them everything else that could be an identifier: tokens with an ``@`` or four
digits, and runs of digit groups joined by single spaces, dots, slashes, hyphens or brackets, as
``(743) 555-3824``; of any length. Each comes with the lexical patterns around it: the two words
before it, the word before and the word after, and the word before alone where that is a label
(ends in ``:``, ``=``, ``#`` or ``.``). The base entities are the seeds. Spark then scores the graph
of patterns and instances for some rounds: a pattern is trusted as far as its distinct instances
are known ones of one kind, an instance as far as the patterns it appears in are trusted; trusted
instances count as known in the next round. At the end, every mention in a trusted pattern whose
instance is trusted is added as a span of the pattern's kind. Base spans always stay. A run and a
token inside it are judged each, so added spans may overlap.

``redact`` reads the texts a second time, with the trusted patterns and instances that were met at
hand; they are sent to the workers if they are at most ``MAX_MODEL``, counted first, and joined
with the rows otherwise, which moves the texts once.

Edge cases: a null text counts as empty and has no spans; ``redact`` leaves it null. Repeated rows
each get their spans; ids are not used to find a row again. Spans are in code points, end
exclusive. Empty tables give empty results. Context is looked for within ``CONTEXT`` code points of
a mention; longer words are not patterns. Other columns of the input are ignored by ``find`` and
kept by ``redact``, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.shared import drop_table, fresh, map_rows, quoted, read, trimmed, tune, with_uid, write_table

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile(r"[0-9]")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[A-Za-z0-9._%+@/#-]+")
GROUPS = re.compile(r"(?<![A-Za-z0-9._%+@/#-])\(?[0-9]++\)?(?:[\x20./-]?\(?[0-9]++\)?)++(?![A-Za-z0-9@])")
#: An instance longer than this goes by its digest.
LONG = 128
#: Trusted patterns, and instances, that may be sent to every worker: about 100 MB.
MAX_MODEL = 200_000
CONTEXT = 80
#: Trust needed, distinct known instances needed, rounds of scoring.
TRUST, SUPPORT, ROUNDS = 0.8, 5, 3

SCAN = "uid long, id {kind}, spans array<struct<start:int,end:int,kind:int>>, mentions array<struct<start:int,end:int,kind:int,inst:string,pats:array<string>>>, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string"


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = done = m.end()
            yield start, end
        at = text.find("@", end)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 10 <= len(DIGIT.findall(m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) by start, then kind."""
    found = [(s, e, 0) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [(s, e, 1) for s, e in ips(text)]
        found += [(s, e, 2) for s, e in cards(text)]
        if "+" in text:
            found += [(s, e, 3) for s, e in phones(text)]
    found.sort(key=lambda x: (x[0], x[2]))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def patterns(text: str, start: int, end: int) -> list[str]:
    left = text[max(0, start - CONTEXT) : start]
    before, after = left.lower().split()[-2:], text[end : end + CONTEXT].lower().split()[:1]
    if start > CONTEXT and before and len(before) == len(left.split()):
        before = before[1:]  # the window's first word may be cut
    out = []
    if len(before) == 2:
        out.append("2 " + " ".join(before))
    if before and after:
        out.append(f"r {before[-1]} _ {after[0]}")
    if before and before[-1][-1] in ":=#." and len(before[-1]) > 1:
        out.append("1 " + before[-1])
    return out


def others(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What could be an identifier beside the base spans."""
    if not (DIGIT.search(text) or "@" in text):
        return []
    found = set()
    for m in TOKEN.finditer(text):
        word = m[0].strip("._%+/#-@")
        if "@" in word or len(DIGIT.findall(word)) >= 4:
            s = m.start() + m[0].index(word)
            found.add((s, s + len(word)))
    found.update(m.span() for m in GROUPS.finditer(text) if len(DIGIT.findall(m[0])) >= 4)
    if not spans:
        return sorted(found)
    taken: list[list[int]] = []
    for s, e, _ in spans:
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    ends = [e for _, e in taken]
    return [(s, e) for s, e in sorted(found) if (i := bisect_right(ends, s)) == len(taken) or taken[i][0] >= e]


def instance(text: str) -> str:
    text = text.lower()
    return text if len(text) <= LONG else hashlib.sha256(text.encode()).hexdigest()


def mentions(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Base spans, and what else could identify somebody (kind -1)."""
    out = [*spans, *((s, e, -1) for s, e in others(text, spans))]
    return [{"start": s, "end": e, "kind": k, "inst": instance(text[s:e]), "pats": patterns(text, s, e)} for s, e, k in out]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for b in batches:
            rows = []
            for text in b.column(2).to_pylist():
                text = text or ""
                spans = base_spans(text)
                n = [0] * 4
                for _, _, k in spans:
                    n[k] += 1
                rows.append(
                    {"spans": [{"start": s, "end": e, "kind": k} for s, e, k in spans], "mentions": mentions(text, spans)}
                    | {f"n_{name}": c for name, c in zip(KINDS, n, strict=True)} | {"base_sha256": hashlib.sha256(joined(spans).encode()).hexdigest()}
                )
            if schema is None:
                i32 = pa.int32()
                span = [("start", i32), ("end", i32), ("kind", i32)]
                schema = pa.schema(
                    [("spans", pa.list_(pa.struct(span))), ("mentions", pa.list_(pa.struct([*span, ("inst", pa.string()), ("pats", pa.list_(pa.string()))]))), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string())]
                )
            made = pa.RecordBatch.from_pylist(rows, schema=schema)
            yield pa.record_batch([b.column(0), b.column(1), *made.columns], names=["uid", "id", *schema.names])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.monotonically_increasing_id().alias("uid"), F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    return rows.mapInArrow(trimmed(run), SCAN.format(kind=kind))


def _mentions(scanned: DataFrame) -> DataFrame:
    return scanned.select("uid", F.explode("mentions").alias("m")).select("uid", "m.*")


def bootstrap(scanned: DataFrame, trust: float = TRUST, support: int = SUPPORT, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Trusted patterns (pat, kind, trust) and known instances (inst, kind, score)."""
    each = _mentions(scanned)
    edges = write_table(each.select("inst", F.explode("pats").alias("pat")).distinct(), "pii-edges")
    seeds = write_table(each.filter("kind >= 0").groupBy("inst", "kind").agg(F.lit(1.0).alias("score")), "pii-seeds")
    degree = edges.groupBy("pat").agg(F.count("*").alias("degree"))
    known, trusted = seeds, None
    for _ in range(rounds):
        score = edges.join(known, "inst").groupBy("pat", "kind").agg(F.sum("score").alias("mass"), F.count("*").alias("n"))
        score = score.filter(F.col("n") >= support).join(degree, "pat").withColumn("trust", F.col("mass") / F.col("degree"))
        trusted = write_table(score.filter(F.col("trust") >= trust).select("pat", "kind", "trust"), "pii-patterns")
        grown = edges.join(trusted, "pat").groupBy("inst", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("trust"), F.lit(0.999)))))).alias("score"))
        grown = grown.filter(F.col("score") >= trust).join(seeds.select("inst"), "inst", "left_anti")
        known = write_table(seeds.unionByName(grown), "pii-known")
    drop_table(edges, seeds)
    return trusted, known


def _added(scanned: DataFrame, trusted: DataFrame, known: DataFrame) -> DataFrame:
    """(uid, start, end, inst, pat, kind, trust) of the mentions that trusted patterns add."""
    found = _mentions(scanned).filter("kind < 0").select("uid", "start", "end", "inst", F.explode("pats").alias("pat"))
    return found.join(trusted, "pat").join(known.select("inst", "kind"), ["inst", "kind"], "left_semi")


def _more(added: DataFrame) -> DataFrame:
    """(uid, more): the added spans of a text, each with the kind of its most trusted pattern."""
    one = added.groupBy("uid", "start", "end").agg(F.max_by("kind", F.struct("trust", -F.col("kind"))).alias("kind"))
    return one.groupBy("uid").agg(F.collect_list(F.struct("start", "end", "kind")).alias("more"))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Per row: (uid, id, counts and digest of the base spans, all_spans array<struct<start,kind,end>>)."""
    scanned = write_table(scan(df, id_col, text_col), "pii-scan")
    more = _more(_added(scanned, *bootstrap(scanned, **how)))
    out = scanned.join(more, "uid", "left")
    spans = F.concat("spans", F.coalesce("more", F.array().cast("array<struct<start:int,end:int,kind:int>>")))
    spans = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return out.select("uid", F.col("id").alias(id_col), *[f"n_{k}" for k in KINDS], "base_sha256", spans.alias("all_spans"))


def spans_string(col):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(col, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span, or run of overlapping spans, replaced by the kind of its first, like [EMAIL].
    spans: (start, end, kind) by start, then kind."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", max_model: int = MAX_MODEL, **how) -> DataFrame:
    """``df`` with all spans replaced; same columns and rows. ``length_col``, if there, follows."""
    scanned = write_table(scan(df, id_col, text_col), "pii-scan")
    trusted, known = bootstrap(scanned, **how)
    added = _added(scanned, trusted, known)
    pats = write_table(added.select("pat", "kind", "trust").distinct(), "pii-used")
    insts = write_table(added.select("inst", "kind").distinct(), "pii-found")
    model = None
    if max(pats.count(), insts.count()) <= max_model:
        by: dict[str, list[tuple[float, int]]] = defaultdict(list)
        for r in pats.toLocalIterator():
            by[r.pat].append((r.trust, -r.kind))
        model = df.sparkSession.sparkContext.broadcast((dict(by), frozenset((r.inst, r.kind) for r in insts.toLocalIterator())))

    def more(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        by, insts = model.value
        out = []
        for s, e in others(text, base) if by else ():
            inst = instance(text[s:e])
            fits = [t for p in patterns(text, s, e) for t in by.get(p, ()) if (inst, -t[1]) in insts]
            if fits:
                out.append((s, e, -max(fits)[1]))
        return out

    at = df.columns.index(text_col)
    place = df.columns.index(length_col) if length_col in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns)
            given = columns[-1].to_pylist() if model is None else None
            texts = columns[at].to_pylist()
            lengths = columns[place].to_pylist() if place is not None else None
            for i, text in enumerate(texts):
                if text:
                    spans = base_spans(text)
                    spans += more(text, spans) if given is None else [(s["start"], s["end"], s["kind"]) for s in given[i] or ()]
                    if spans:
                        texts[i] = redact_text(text, sorted(spans, key=lambda x: (x[0], x[2], x[1])))
                        if lengths:
                            lengths[i] = len(texts[i])
            columns[at] = pa.array(texts, columns[at].type)
            if lengths is not None:
                columns[place] = pa.array(lengths, columns[place].type)
            yield pa.record_batch(columns, names=b.schema.names)

    if model is not None:
        drop_table(scanned)
        return map_rows(df, run)
    docs, uid = with_uid(df, "pii-docs")
    scanned = write_table(scan(docs, uid, text_col), "pii-scan")
    spans = _more(_added(scanned, trusted, known).join(scanned.select("uid", "id"), "uid").drop("uid").withColumnRenamed("id", "uid"))
    added_col = fresh(docs, "more")
    rows = docs.join(spans.toDF(uid, added_col), uid, "left").drop(uid)
    return map_rows(rows, run).drop(added_col)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    out = find(read(spark, sf_dir, "documents"))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", spans_string(F.col("all_spans")).alias("spans"))
