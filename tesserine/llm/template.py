"""Problem 2: site furniture around the body of a page.

Method: equivalence-class template deduction.  A page's html becomes tokens: every
container, told apart by its path of containers (the role of its tokens), and every
run of text in its container.  The occurrence vector of a token over the pages of
its host is kept as an order-free hash of (page, count) pairs with the number of
pages, so vectors are formed by map-side combined aggregates however many pages a
host has.  Tokens of one vector form an equivalence class (a container's opening
and closing always share theirs).  A class is valid if it has at least two tokens
on at least two pages once those out of order are left out: sorted by their first,
their last and their mean place on the pages, its tokens come out the same, each
with a place of its own.

Valid containers, nested by their paths, are the host's template; text tokens of a
valid class are template text if they stand on at least ``TEMPLATE_SHARE`` of the
pages of a host and ``TEMPLATE_PAGES`` of them (fewer pages may be copies of one
another).  A container outside the template belongs to the slot of the valid
container around it.  What remains in the slots once the template's text is taken
out is the pages' own; the body is the deepest slot that at least ``MAIN`` of the
host's remaining words pass through, and everything else is furniture.

A page that lacks its host's body slot follows another template, and a page alone
on its host has none to compare with; both are read by the containers that pages
of different hosts have in common: their body is the page's slot with most words a
page across the collection (14 % of the pages of sf0.1).

The lines of the extracted text are found again among the text tokens, after
repair of wrong encodings.  Lines found nowhere (pages without html, lost
letters) are judged by how the same line template fell on pages with html, else
by the shapes of the line and its neighbours (at most 41^3 of them).

Defined results: rows without key are left out; NULL or empty text has no lines; blank lines are never
furniture; line numbers count from 0; repeated rows are judged alike; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import WORD, cut, small
from .encoding import analyser, pairs_of
from .residue import line_mask, orphan, page_places, title_of
from .spam import TOKEN, Learnt

TEMPLATE_PAGES, TEMPLATE_SHARE = 6, 0.6
MAIN = 0.5
SEEN, CLEAR = 3, 8
FORM_CACHE = 100_000
_forms: dict[str, tuple[int, str, int, str, list[str], list[str]]] = {}

_DROP = re.compile(r"(?is)<!--.*?-->|<(script|style|head|template)\b[^>]*>.*?</\1\s*>|<!doctype[^>]*>")
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>\"']*+(?:(?:\"[^\"]*\"|'[^']*')[^<>\"']*+)*+)>")
_NAMED = re.compile(r"""(?:^|\s)(class|id)\s*=\s*["']?([^"'\s>]+)""")
_CONTAINERS = frozenset("div nav article main header footer section aside table thead tbody tr td th ul ol dl form noscript figure".split())
_INLINE = frozenset("a b i u em strong span small sup sub font abbr code mark".split())
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"\s*[|·•/>»]\s*| {2,}|\s-\s")
_HIGHER = re.compile(r"[^\x00-\x7f]")


def key_of(s: str) -> str:
    """Letters and digits of a run of text, by which a line finds it again."""
    return "".join(WORD.findall(s.lower()))


def segments(page: str) -> list[tuple[tuple[str, ...], str]]:
    """(container path, text) of every run of text between tags, and of the
    runs of a block that inline tags part, joined."""
    out: list[tuple[tuple[str, ...], str]] = []
    stack: list[tuple[str, str]] = []
    block: list[str] = []
    path: tuple[str, ...] = ()
    at = 0

    def flush() -> None:
        if len(block) > 1:
            out.append((path, " ".join(block)))
        block.clear()

    def run(text: str) -> None:
        text = text.strip()
        if not text:
            return
        if "&" in text:
            text = _html.unescape(text)
        if "\n" in text or "  " in text or not text.isprintable():
            text = _SPACE.sub(" ", text).strip()
        if text:
            out.append((path, text))
            block.append(text)

    page = _DROP.sub(" ", page)
    for m in _TAG.finditer(page):
        if m.start() > at:
            run(page[at : m.start()])
        at = m.end()
        close, tag, rest = m.groups()
        tag = tag.lower()
        named = _NAMED.search(rest) if rest else None
        container = tag in _CONTAINERS or tag == "span" and (named is not None or close and any(t == "span" for t, _ in stack))
        if container:
            flush()
            if not close:
                stack.append((tag, tag + ("." if not named else named.group(1)[0] + re.sub(r"\d+", "0", named.group(2)))))
            elif any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
            path = tuple(n for _, n in stack)
            if not close and container:
                out.append((path, ""))
        elif tag not in _INLINE:
            flush()
    if at < len(page):
        run(page[at:])
    flush()
    return out


def _id(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(parts)) - (1 << 63)


def shape(line: str, n: int) -> str:
    """Form of a line: its length class, its end, a list mark, separators."""
    s = line.strip()
    size = "0" if n == 0 else "1" if n == 1 else "2" if n < 4 else "3" if n < 9 else "4" if n < 21 else "5"
    return size + ("." if s[-1:] in ".!?”»\"…" else "") + ("-" if s[:1] in "-•*" else "") + ("|" if n < 21 and _PARTS.search(s[1:-1]) else "")


def line_form(line: str) -> tuple[int, str, int, str, list[str], list[str]]:
    """(words, key, mask, shape, the words, the tokens) of a line; those of short
    lines, which recur, are kept per worker."""
    got = _forms.get(line)
    if got is None:
        ws = WORD.findall(line.lower())
        n = len(ws)
        tokens = TOKEN.findall(line)
        got = n, "".join(ws), line_mask(line, tokens), shape(line, n), ws, tokens
        if n < 9:
            if len(_forms) > FORM_CACHE:
                _forms.clear()
            _forms[line] = got
    return got


def analyse(text: str, page: str | None, function: frozenset[str] | set[str] = frozenset()) -> tuple[list, list, list, list, set[str], list[str]]:
    """(lines, slots, tokens, orphan lines, words, tokens of the text) of a page;
    see SCHEMA."""
    lost = "\ufffd" in text or "?" in text
    forms, orphans, said, keys, read = [], [], set(), {}, []
    for i, x in enumerate(text.split("\n")):
        if i:
            read.append("\n")
        if x.strip():
            n, k, mask, form, ws, part = line_form(x)
            read += part
            forms.append((i, x, n, k, mask, form))
            keys[x] = k
            said.update(ws)
            if function and orphan(x, ws, function):
                orphans.append((i, ws))
    where: dict[str, tuple[tuple[int, ...], int]] = {}
    loose: dict[str, tuple[tuple[int, ...], int]] = {}
    tokens: dict[int, list] = {}
    paths: dict[tuple[str, ...], tuple[int, ...]] = {}
    if page:
        for pos, (path, run) in enumerate(segments(page)):
            up = paths.get(path)
            if up is None:
                up = paths[path] = tuple(_id(*path[: i + 1]) for i in range(len(path))) or (0,)
            slot = up[-1]
            if not run:
                t, kind = slot, 0
            else:
                k = keys.get(run)
                if k is None:
                    k = key_of(run)
                if not k:
                    continue
                t, kind = _id(str(slot), k), 1
                where.setdefault(k, (up, t))
                if lost:
                    loose.setdefault(_HIGHER.sub("", k), (up, t))
            tok = tokens.setdefault(t, [t, 0, pos, kind])
            tok[1] += 1
    lines = []
    slots: dict[tuple[int, ...], int] = {}
    for j, (i, x, n, k, mask, form) in enumerate(forms):
        got = where.get(k) if k else None
        if got is None and k:
            parts = [key_of(p) for p in _PARTS.split(x)]
            found = {where[p] for p in parts if p in where} if len(parts) > 1 and all(p in where for p in parts if p) else set()
            if found and len({f[0] for f in found}) == 1:
                got = min(found)
            elif lost and len(low := _HIGHER.sub("", k)) > 3:
                got = loose.get(low)
        trio = "/".join((forms[j - 1][5] if j else "^", form, forms[j + 1][5] if j + 1 < len(forms) else "$"))
        lines.append((i, got[0][-1] if got else None, got[1] if got else 0, n, mask, trio))
        if got:
            slots[got[0]] = slots.get(got[0], 0) + n
    return lines, [(up[-1], list(up), n) for up, n in slots.items()], list(tokens.values()), orphans, said, read


_I64, _I32, _STR = pa.int64(), pa.int32(), pa.string()
_LIST = pa.list_
_LINE = pa.struct([("no", _I32), ("slot", _I64), ("tok", _I64), ("words", _I32), ("mask", _I64), ("shape", _STR)])
_ARROW = pa.schema(
    [
        ("fetch_id", _I64), ("domain", _STR), ("lines", _LIST(_LINE)), ("slots", _LIST(pa.struct([("slot", _I64), ("up", _LIST(_I64)), ("words", _I32)]))),
        ("toks", _LIST(pa.struct([("tok", _I64), ("n", _I32), ("pos", _I32), ("kind", _I32)]))), ("orphans", _LIST(pa.struct([("no", _I32), ("words", _LIST(_STR))]))),
        ("places", _LIST(pa.struct([("name", _STR), ("context", _I64)]))), ("unfilled", pa.bool_()), ("title", _STR), ("unrelated", pa.bool_()),
        ("garbled_text", pa.bool_()), ("garbled_html", pa.bool_()), ("spam", pa.bool_()),
    ]
)
SCHEMA = from_arrow_schema(_ARROW)


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """A column of lists of tuples, built flat: one array per field."""
    if not (pa.types.is_list(kind) and pa.types.is_struct(kind.value_type)):
        return pa.array(values, kind)
    flat = list(chain.from_iterable(values))
    fields = list(kind.value_type)
    parts = list(zip(*flat)) if flat else [()] * len(fields)
    return pa.ListArray.from_arrays(
        pa.array(list(accumulate(map(len, values), initial=0)), pa.int32()),
        pa.StructArray.from_arrays([pa.array(p, f.type) for p, f in zip(parts, fields)], fields=fields),
    )


def parsed(pages: DataFrame, samples: DataFrame, spam_too: bool = False, learnt: Learnt | None = None) -> DataFrame:
    """One row per page with text; lineage is cut, as every step reads it.  With
    ``spam_too`` the pages' texts are also judged by problem 3 while at hand;
    ``learnt`` is its model, if there is one already."""
    from . import spam

    learnt, pairs = learnt or spam.learn(samples), pairs_of(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        an, prose = analyser(pairs), spam.prose_of(learnt)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                out = []
                for i, d, t, h, title in zip(*(c.to_pylist() for c in b.slice(lo, 500).columns)):
                    t = t or ""
                    garbled = an.affected(t), an.affected(h)
                    right = an.restore(t)[0] if garbled[0] else t
                    lines, slots, toks, orphans, said, read = analyse(right, an.restore(h)[0] if garbled[1] else h, prose.function)
                    judged = spam.judge_right(right, prose, garbled[0], read) if spam_too else None
                    out.append((i, d, lines, slots, toks, orphans, *page_places(t, title), *title_of(title, d, said), *garbled, bool(judged and judged[0])))
                yield pa.RecordBatch.from_arrays([_column(list(c), f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)

    src = pages.select(F.col("fetch_id").cast("long").alias("fetch_id"), F.coalesce("domain", F.lit("")).alias("domain"), "text", "html", "title")
    src = src.where("fetch_id is not null and (coalesce(text, '') <> '' or coalesce(title, '') <> '')")
    return cut(src.mapInArrow(run, SCHEMA))


def classes(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(domain, tok) of the containers and of the text of the hosts' templates."""
    tok = pages.where("domain <> ''").select("domain", "fetch_id", F.explode("toks").alias("t")).select("domain", "fetch_id", "t.*")
    vector = tok.groupBy("domain", "tok", "kind").agg(
        F.bit_xor(F.xxhash64("fetch_id", "n")).alias("sig"), F.count("*").alias("support"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.sum("pos").alias("sum")
    )
    member = F.collect_list(F.struct("lo", "hi", "sum", "tok", "kind")).alias("m")  # no more than tokens stand on one page
    cls = vector.where((F.col("support") > 1) & ((F.col("kind") == 0) | (F.col("support") >= TEMPLATE_PAGES))).groupBy("domain", "sig", "support").agg(member)
    by = lambda k: F.expr(f"array_sort(transform(m, x -> struct(x.{k} as k, x.tok, x.kind)))").alias(k)
    same = "x.tok = hi[i].tok and x.tok = sum[i].tok and (i = 0 or lo[i - 1].k < x.k) and (i + 1 = size(lo) or x.k < lo[i + 1].k)"
    kept = cls.select("domain", "support", by("lo"), by("hi"), by("sum")).select("domain", "support", F.expr(f"filter(lo, (x, i) -> {same})").alias("m"))
    two = F.expr("aggregate(m, 0, (n, x) -> n + if(x.kind = 0, 2, 1))") > 1
    valid = kept.where(two).select("domain", "support", F.explode("m").alias("x")).select("domain", "support", "x.tok", "x.kind")
    valid = cut(valid)
    size = pages.where("domain <> ''").groupBy("domain").agg(F.count("*").alias("pages"))
    texts = valid.where((F.col("kind") == 1) & (F.col("support") >= TEMPLATE_PAGES)).join(size, "domain").where(F.col("support") >= TEMPLATE_SHARE * F.col("pages"))
    return valid.where("kind = 0").select("domain", "tok"), texts.select("domain", "tok")


def body_slots(pages: DataFrame, boxes: DataFrame, texts: DataFrame) -> DataFrame:
    """(fetch_id, body): the slot that holds a page's body."""
    slot = pages.select("fetch_id", "domain", F.explode("slots").alias("s")).select("fetch_id", "domain", "s.*")
    own = cut(slot.groupBy("domain", "slot").agg(F.any_value("up").alias("up"), F.sum("words").alias("words"), F.count("*").alias("pages")))
    line = pages.select("domain", F.explode("lines").alias("l")).where("l.slot is not null")
    fixed = line.select("domain", F.col("l.slot").alias("slot"), F.col("l.tok").alias("tok"), F.col("l.words").alias("words"))
    fixed = fixed.join(texts, ["domain", "tok"], "left_semi").groupBy("domain", "slot").agg(F.sum("words").alias("fixed"))
    left = own.where("domain <> ''").join(fixed, ["domain", "slot"], "left").select("domain", "up", (F.col("words") - F.coalesce("fixed", F.lit(0))).alias("words"))
    total = left.groupBy("domain").agg(F.sum("words").alias("total"))
    through = left.select("domain", "words", F.posexplode("up").alias("depth", "tok")).join(boxes, ["domain", "tok"], "left_semi")
    through = through.groupBy("domain", "tok").agg(F.max("depth").alias("depth"), F.sum("words").alias("words")).join(total, "domain")
    main = through.where(F.col("words") >= MAIN * F.col("total")).groupBy("domain").agg(F.max_by("tok", F.struct("depth", "words", "tok")).alias("main"))
    pool = own.groupBy("slot").agg((F.sum("words") / F.sum("pages")).alias("score"), F.sum("pages").alias("n")).where("n > 1 and slot <> 0").select("slot", "score")
    of = slot.join(small(main, "24 + length(domain)"), "domain", "left").join(small(pool), "slot", "left")
    return of.groupBy("fetch_id").agg(
        F.coalesce(F.max(F.when(F.array_contains("up", F.col("main")), F.col("main"))), F.max_by("slot", F.when(F.col("score").isNotNull(), F.struct("score", "slot")))).alias("body")
    )


def judged_lines(pages: DataFrame) -> DataFrame:
    """(fetch_id, domain, no, words, mask, furniture) of all non-blank lines."""
    boxes, texts = classes(pages)
    texts = small(texts, "24 + length(domain)")
    body = small(body_slots(pages, boxes, texts), "16")
    inside = F.expr("transform(filter(slots, s -> array_contains(s.up, body)), s -> s.slot)")
    line = (
        pages.select("fetch_id", "domain", "lines", "slots")
        .join(body, "fetch_id", "left")
        .select("fetch_id", "domain", inside.alias("inside"), F.explode("lines").alias("l"))
        .select("fetch_id", "domain", "inside", "l.*")
        .join(texts.withColumn("template", F.lit(True)), ["domain", "tok"], "left")
    )
    line = cut(
        line.select(
            "fetch_id", "domain", "no", "words", "mask", "shape",
            F.when(F.size("inside") > 0, F.coalesce("template", F.lit(False)) | ~F.array_contains("inside", F.col("slot"))).alias("known"),
        )
    )
    seen = line.where("known is not null")
    unknown = cut(line.where("known is null"))
    masks = small(unknown.select("mask").distinct(), "8")
    by_mask = seen.join(masks, "mask", "left_semi").groupBy("mask").agg(F.count("*").alias("n"), F.avg(F.col("known").cast("int")).alias("p")).where(F.col("n") >= SEEN)
    by_shape = seen.groupBy("shape").agg(F.count("*").alias("sn"), F.avg(F.col("known").cast("int")).alias("sp")).where(F.col("sn") >= SEEN)
    rest = unknown.join(by_mask, "mask", "left").join(by_shape, "shape", "left")
    clear = F.when((F.col("n") >= CLEAR) & ((F.col("p") <= 0.1) | (F.col("p") >= 0.9)), F.col("p"))
    rest = rest.withColumn("furniture", F.coalesce(clear, F.col("sp"), F.col("p"), F.lit(0.0)) > 0.5)
    cols = ["fetch_id", "domain", "no", "words", "mask"]
    return seen.select(*cols, F.col("known").alias("furniture")).unionByName(cut(rest.select(*cols, "furniture")))


def found(pages: DataFrame, samples: DataFrame) -> DataFrame:
    """(fetch_id, line_no) of the furniture lines; spam and residue pages have
    no body that furniture could stand around."""
    from . import residue

    page = parsed(pages, samples, spam_too=True)
    line = judged_lines(page)
    drop = residue.found(page, line, pages).union(page.where("spam").select("fetch_id")).distinct()
    return line.where("furniture").select("fetch_id", F.col("no").cast("long").alias("line_no")).join(small(drop, "8"), "fetch_id", "left_anti").distinct()


def bodies(pages: DataFrame, samples: DataFrame) -> DataFrame:
    """(fetch_id, lines, body_lines, body): the text without its furniture."""
    line = judged_lines(parsed(pages, samples))
    kept = line.groupBy("fetch_id").agg(F.count("*").alias("lines"), F.count_if(~F.col("furniture")).alias("body_lines"), F.array_sort(F.collect_set(F.when(~F.col("furniture"), F.col("no")))).alias("keep"))
    text = F.array_join(F.expr("transform(keep, i -> get(split(text, '\n', -1), i))"), "\n")
    return pages.select(F.col("fetch_id").cast("long").alias("fetch_id"), "text").join(kept, "fetch_id").select("fetch_id", "lines", "body_lines", text.alias("body"))
