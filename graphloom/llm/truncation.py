"""Texts cut off by field limits: right-censored length distributions per source, combined with the evidence of the ending.

1. Per source, a log-normal length distribution is fitted by maximum likelihood, with the texts at candidate limits (lengths
   far more frequent than their surroundings) treated as right-censored; this gives each limit's censoring posterior.
2. The ending of every text is described by a few discrete features. Two of them need the corpus: how often the last tokens end
   a line or sentence, and how often the last word occurs whole. They come from counts over all texts, joined by 64-bit keys
   to the endings that ask for them, so nothing is gathered and no two keys share a count. That other texts end alike counts
   only as far as cuts do not explain it: in a large corpus cuts at the same place are many, and prove nothing.
3. The distribution of the features under a cut is known, from one hash-seeded artificial cut of every text; that of whole
   texts, and each source's rate of cuts at and off its limits, follow by expectation maximisation from the real endings,
   starting from the censoring posteriors.
4. A text is reported if the posterior of a cut exceeds the threshold.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import broadcast_if_small, materialize, written

#: Keys a task holds before it adds up their counts and sends them on.
HELD = 1 << 20

#: What cutting programs put behind a cut.
MARKERS = re.compile(r"(?:\s*(?://|#|--|/\*)?\s*[\[(<]\s*(?:truncated|cut|snip(?:ped)?|more|continued|\.\.\.|…)[^\])>\n]{0,20}[\])>](?:\s*\*/)?)$", re.I)
ELLIPSIS = re.compile(r"\s*(?:…|\.{3,})$")

TOKEN = re.compile(
    r"(?P<nl>\n)|(?P<path>/[\w{}](?:[\w{}/.-]*[\w{}/])?)|(?P<hex>\b[0-9a-f]{16,}\b)|(?P<version>\bv\d+(?:\.\d+)*)|(?P<name>[A-Z]\w*(?:\\\w+)+\\?)"
    r"|(?P<key>\b[a-z_]+(?:\.[a-z_]+)+)|(?P<number>\d+)|(?P<var>\$\w*)|(?P<word>[^\W\d_][\w]*)|(?P<mark>[.!?][^\S\n]?|[^\s\w])|(?P<other>\w+)"
)
#: The same for finding tokens only. A stop takes the space behind it along, which tells it from one inside a name.
FIND = re.compile(re.sub(r"\(\?P<\w+>", "(?:", TOKEN.pattern)).findall
PIECE = re.compile(r"[A-Z]+[a-zà-ÿ]*|[a-zà-ÿß]+|[^\W\d_]+")


def source_key(source: Column) -> Column:
    """Spelling variants of a source as one: lower case, trimmed, runs of spaces and hyphens as an underscore; blank is null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(source)), r"[\s_-]+", "_"), F.lit(""))


def shape(kind: str, text: str) -> str:
    if kind == "version" or kind == "key":
        return f"{kind[0].upper()}{text.count('.') + 1}"
    if kind == "word":
        if text[0].isupper():
            return "C" if any(c.isupper() for c in text[1:]) and not text.isupper() else "A"
        return "m" if any(c.isupper() for c in text) else "s" if "_" in text else text
    return {"mark": text, "nl": "\n"}.get(kind, kind)


NEWLINE, CAPITAL, STOP, UPPER = 1, 2, 4, 8
MASK = (1 << 64) - 1


def text_hash(text: str) -> int:
    """64 bits of a text, the same in every process."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big")


def signed(h: int) -> int:
    """A hash as a bigint."""
    return h - (1 << 64) if h >> 63 else h


class Token:
    """What there is to know about a token, whatever surrounds it."""

    __slots__ = ("alike", "flags", "kind", "last_piece", "literal", "pieces", "shape", "text")

    def __init__(self, kind: str, spelled: str):
        text = spelled.rstrip() or spelled
        s = shape(kind, text)
        self.kind, self.text = kind, text
        self.shape, self.literal = text_hash(s), text_hash(text)
        self.alike = text_hash("X" if s in ("A", "C", "m") else s)
        self.flags = NEWLINE * (kind == "nl") + CAPITAL * (s == "A") + STOP * (text in (".", "!", "?") and spelled != text) + UPPER * text[0].isupper()
        found = PIECE.findall(text) if kind in ("word", "name", "key", "path", "var", "other") else []
        self.pieces = [signed(text_hash("w\x00" + p.lower())) for p in found]
        self.last_piece = self.pieces[-1] if found and text[-1].isalpha() else None


class Vocabulary(dict):
    """Token text -> number, and what there is to know about the tokens in arrays by that number."""

    def __init__(self) -> None:
        super().__init__()
        self.tokens: list[Token] = []
        self.flags, self.first_piece, self.n_pieces = (np.zeros(0, np.int64) for _ in range(3))
        self.shape, self.literal, self.alike = (np.zeros(0, np.uint64) for _ in range(3))
        self.pieces = np.zeros(0, np.int64)

    def __missing__(self, text: str) -> int:
        m = TOKEN.match(text)
        self.tokens.append(Token(m.lastgroup if m and m.end() == len(text) else "other", text))
        self[text] = len(self.tokens) - 1
        return len(self.tokens) - 1

    def learn(self) -> None:
        """Bring the arrays up to date."""
        new = self.tokens[len(self.flags) :]
        if new:
            count = np.array([len(t.pieces) for t in new])
            self.first_piece = np.append(self.first_piece, len(self.pieces) + np.cumsum(count) - count)
            self.n_pieces = np.append(self.n_pieces, count)
            self.pieces = np.append(self.pieces, np.array([p for t in new for p in t.pieces], np.int64))
            self.flags = np.append(self.flags, [t.flags for t in new])
            for name in ("shape", "literal", "alike"):
                setattr(self, name, np.append(getattr(self, name), np.array([getattr(t, name) for t in new], np.uint64)))


_vocabulary = Vocabulary()


def vocabulary() -> Vocabulary:
    """The one of this process, begun again before it grows too large; to be asked for once per piece of work."""
    global _vocabulary
    if len(_vocabulary) > 400_000:
        _vocabulary = Vocabulary()
    return _vocabulary


def tokens(text: str) -> list[Token]:
    known = vocabulary()
    return [known.tokens[known[t]] for t in FIND(text)]


BEGIN = np.uint64(text_hash("^"))
LONGEST_LINE = 14
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(LONGEST_LINE)], np.uint64)
_M1, _M2, _M3 = (np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15))


def _to_key(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def contexts(source: np.ndarray, known: Vocabulary, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token the keys of the last three shapes up to it within its line, for its source (by hash) and for all; and of its line as a whole.

    A capitalised word that begins a line counts as itself. In whole lines names are all alike; -1 stands for lines of more
    than LONGEST_LINE tokens, which hardly ever repeat.
    """
    n = len(ids)
    with np.errstate(over="ignore"):
        flags, literal = known.flags[ids], known.literal[ids]
        newline = (flags & NEWLINE) > 0
        start = np.append(0, np.flatnonzero(newline) + 1)[np.cumsum(newline) - newline]  # where each token's line begins
        place = np.arange(n) - start
        capital = (place == 0) & ((flags & CAPITAL) > 0)
        now = np.where(capital, literal, known.shape[ids])
        before, earlier = np.full(n, BEGIN), np.full(n, BEGIN)
        before[1:] = np.where(place[1:] >= 1, now[:-1], BEGIN)
        earlier[2:] = np.where(place[2:] >= 2, now[:-2], BEGIN)
        three = (now * _M1) ^ ((before * _M2) + (earlier * _M3))
        alike = np.where(capital, literal, known.alike[ids])
        total = np.cumsum(alike * _POWERS[np.minimum(place, LONGEST_LINE - 1)], dtype=np.uint64)
        line = total - np.where(start > 0, total[np.maximum(start - 1, 0)], np.uint64(0))
        whole = np.where(place < LONGEST_LINE, _to_key(line ^ np.uint64(_LINE)), -1)
        return _to_key(three ^ source), _to_key(three), whole


def strip_end(text: str) -> tuple[str, str]:
    """The text up to where it stops, and what stands after the stop: marker, ellipsis, broken (half a character) or plain."""
    bare = text.rstrip()
    at = max(0, len(bare) - 80)
    if m := MARKERS.search(bare, at):
        return bare[: m.start()].rstrip(), "marker"
    if bare.endswith("�"):
        return bare.rstrip("�"), "broken"
    if m := ELLIPSIS.search(bare, at):
        return bare[: m.start()].rstrip(), "ellipsis"
    return bare, "plain"


def count_tokens(texts: list[tuple[str, str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, whether each ends a line or sentence) of the token contexts, lines and word pieces of texts (source, text).

    The last token of a text is left out, it is what is to be judged. The texts are taken together, a line feed between them.
    """
    known, ids, sizes, sources = vocabulary(), [], [], []
    feed = known["\n"]
    for source, text in texts:
        found = FIND(strip_end(text)[0])
        if len(found) >= 2:
            ids += map(known.__getitem__, found)
            ids.append(feed)
            sizes.append(len(found) + 1)
            sources.append(_source_hash(source))
    if not ids:
        return
    known.learn()
    at = np.array(ids, np.int64)
    inner = np.ones(len(at), bool)
    ends = np.cumsum(sizes)
    inner[ends - 1] = inner[ends - 2] = False
    own, general, whole = contexts(np.repeat(np.array(sources, np.uint64), sizes), known, at)
    flags = known.flags[at]
    after = np.append(flags[1:], 0)
    here = inner & ((flags & NEWLINE) == 0)
    line_end = (after & NEWLINE) > 0
    end = line_end | (((flags & STOP) > 0) & ((after & UPPER) > 0))
    for keys in (own, general):
        yield keys[here], end[here]
    lines = whole[here & line_end & (whole != -1)]
    yield lines, np.ones(len(lines), bool)
    used = at[inner]
    count = known.n_pieces[used]
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    pieces = known.pieces[np.repeat(known.first_piece[used], count) + offset]
    yield pieces, np.zeros(len(pieces), bool)


def _added_up(held: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    ends = np.bincount(at[np.concatenate([e for _, e in held])], minlength=len(keys))
    return pd.DataFrame({"key": keys, "total": np.bincount(at, minlength=len(keys)), "ends": ends})


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for batch in batches:
        texts, size = [], 0
        for source, text in zip(batch["source"], batch["text"]):
            texts.append((source if isinstance(source, str) else "", text))
            size += len(text)
            if size >= 1 << 20:
                held += count_tokens(texts)
                n, texts, size = sum(len(k) for k, _ in held), [], 0
            if n >= HELD:
                yield _added_up(held)
                held, n = [], 0
        held += count_tokens(texts)
        n = sum(len(k) for k, _ in held)
    if n:
        yield _added_up(held)


def ending(source: str, bare: str) -> tuple[list[Token], tuple[int, int, int]]:
    """The tokens of a text's last line, or of its last 150 characters, and what ``contexts`` gives for the last of them."""
    line = bare[bare.rfind("\n") + 1 :]
    found = tokens(line if len(line) <= 250 else line[-150:])
    if not found:
        return [], (-1, -1, -1)
    whole_line = len(line) <= 250
    now = [t.shape for t in found[-3:]]
    if whole_line and found[0].flags & CAPITAL and len(found) <= 3:
        now[0] = found[0].literal
    a, b, c = ([int(BEGIN)] * 3 + now)[-3:]
    three = ((c * int(_M1)) ^ (b * int(_M2) + a * int(_M3))) & MASK
    whole = -1
    if whole_line and len(found) <= LONGEST_LINE:
        h = sum((t.literal if k == 0 and t.flags & CAPITAL else t.alike) * p for k, (t, p) in enumerate(zip(found, _PYTHON_POWERS))) & MASK
        whole = _one_key(h ^ _LINE)
    return found, (_one_key(three ^ _source_hash(source)), _one_key(three), whole)


_PYTHON_POWERS, _LINE = [int(p) for p in _POWERS], text_hash("line")


@cache
def _source_hash(source: str) -> int:
    return text_hash("s\x00" + source)


def _one_key(h: int) -> int:
    h = ((h ^ (h >> 33)) * int(_M1)) & MASK
    return signed(h ^ (h >> 29))


def cut_shares(sketches: DataFrame) -> DataFrame:
    """(share_of, share): per source how many cuts off the limits there may be at a place for each artificial cut that falls there.

    The share of cuts as far as it shows without counts, from endings that hold no ?; a source whose artificial cuts have few of
    these leans on what holds for all. Then tenfold, or up to a quarter, or threefold if that is more: cutters prefer some places,
    and where whole texts end, endings are far more often seen than that.
    """
    seen = sketches.where("limit_key = 'off'").groupBy("source", F.col("real_word").alias("word")).agg(F.count("*").alias("real"), F.lit(0).cast("bigint").alias("made"))
    cut = sketches.groupBy("source", F.col("made_word").alias("word")).agg(F.lit(0).cast("bigint").alias("real"), F.count("*").alias("made"))
    tally = materialize(seen.unionByName(cut).groupBy("source", "word").agg(F.sum("real").alias("real"), F.sum("made").alias("made")))

    def share(words: list[str], real: list[int], made: list[int]) -> tuple[float, float]:
        total = max(1, sum(made))
        clear = {w: n / total for w, n in zip(words, made) if n and "?" not in w and w.endswith("|plain")}
        return share_of_cuts(dict(zip(words, real)), clear), total * sum(clear.values())

    overall = tally.groupBy("word").agg(F.sum("real").alias("real"), F.sum("made").alias("made")).collect()  # as many rows as there are words
    base, _ = share([r["word"] for r in overall], [r["real"] for r in overall], [r["made"] for r in overall])

    def per_source(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own, n = share(frame["word"].tolist(), frame["real"].tolist(), frame["made"].tolist())
        fitted = (n * own + 200 * base) / (n + 200)
        return pd.DataFrame([(key[0], max(3 * fitted, min(10 * fitted, 0.25)))], columns=["share_of", "share"])

    return materialize(tally.groupBy("source").applyInPandas(per_source, "share_of string, share double"))


def corpus_counts(sketches: DataFrame, texts: DataFrame, shares: DataFrame | None = None) -> DataFrame:
    """(key, total, ends, texts, cuts) over all texts: inner occurrences, those that end a line or sentence, distinct texts off the
    limits that end so (at a limit most endings are cuts and prove nothing), and how many of these cuts may explain."""
    inner = texts.select("source", "text").mapInPandas(_count, "key bigint, total bigint, ends bigint")
    inner = inner.groupBy("key").agg(F.sum("total").alias("total"), F.sum("ends").alias("ends"))
    shares = cut_shares(sketches) if shares is None else shares
    known = sketches.join(broadcast_if_small(shares, 200_000), F.col("source").eqNullSafe(F.col("share_of")), "left")
    real = known.where("limit_key = 'off'").select(F.explode("real_keys").alias("key"), "h", F.lit(1).alias("texts"), F.lit(0.0).alias("cuts"))
    made = known.select(F.explode("made_keys").alias("key"), "h", F.lit(0).alias("texts"), F.col("share").alias("cuts"))
    last = real.unionByName(made).where("key IS NOT NULL").groupBy("key", "h").agg(F.max("texts").alias("texts"), F.max("cuts").alias("cuts"))
    last = last.groupBy("key").agg(F.sum("texts").alias("texts"), F.sum("cuts").alias("cuts"))
    return inner.join(last, "key", "full").na.fill(0)


def _balance(text: str) -> bool:
    """Whether brackets and backticks opened in the last line are closed there."""
    line = text[text.rfind("\n") + 1 :]
    return line.count("(") <= line.count(")") and line.count("[") <= line.count("]") and line.count("`") % 2 == 0 and line.count('"') % 2 == 0


CODE_LINE = re.compile(r"[;{}]\s*$", re.M)
COMMENT = re.compile(r"^\s*/\*", re.M)
HEADER = re.compile(r"^\s*(?:(?:abstract|final|readonly|public|private|protected|static|export|default) )*(?:class|interface|trait|enum|struct|module|namespace)\s+\w", re.M)
FIELD = re.compile(r"[A-Za-z_]\w*:(?: |$)")
FIELDS = re.compile(r"(?:[A-Za-z_]\w*: [^\n]*\n){2}")


def structure(text: str) -> str:
    """open: inside a record, comment, fence or bracket that is not closed; shut: at the end of one; flat: neither.

    Code is told by lines that end in a semicolon or brace, a record by its opening brace, a text of labelled fields by the
    labels that begin it; nothing depends on which labels a source uses.
    """
    head, tail = text[:400].lstrip(), text[text.rfind("\n") + 1 :].strip()
    if head.startswith("{") and tail.startswith("{"):
        try:
            json.loads(tail)
            return "shut"
        except (ValueError, RecursionError):
            return "open"
    if head.startswith("/*") and "*/" not in text[:-2]:
        return "shut" if text.endswith("*/") else "open"
    comments = [m.start() for m in COMMENT.finditer(text)]
    if text.count("```") % 2 or (comments and text.find("*/", comments[-1]) < 0):
        return "open"
    if tail.startswith("```"):
        return "shut"
    labelled = FIELDS.match(head) is not None
    first = CODE_LINE.search(text) if "```" not in text else None  # what is fenced is closed
    if first and (labelled or len(CODE_LINE.findall(text, 0, 4000)) >= 2):
        depth = text.count("{") - text.count("}")
        if (opening := HEADER.search(text, 0, first.end())) and opening.start() <= first.start():  # a header has its brace open by nature
            return "flat" if depth == 1 and _balance(text) else "shut" if depth == 0 and text.endswith("}") else "open"
        return "shut" if depth == 0 and text.endswith(("}", ";")) else "open"
    if labelled and FIELD.match(tail):  # it ends where only labels have been
        return "open"
    return "flat" if _balance(text) else "open"


NO_KEYS = [None] * 4


def sketch(source: str, text: str) -> tuple[str, list[int | None]]:
    """The features of an ending as one word, and the keys of its contexts, line and last piece; ? and @ stand for what their counts tell."""
    bare, after = strip_end(text)
    found, (own, general, whole) = ending(source, bare)
    if not found:
        return "none", NO_KEYS
    keys = [own, general, None if whole == -1 else whole, found[-1].last_piece]
    if after in ("marker", "broken"):
        return after, keys
    kind, t = found[-1].kind, found[-1].text
    last = "stop" if t in ".!?" else "close" if t in ")]}`*/\"'" else "mark" if kind == "mark" else "word"
    built = structure(bare)
    if built == "open" or last == "mark":
        return "|".join((built, last, after)), keys
    if last in ("stop", "close"):
        return "|".join((built, last, "?", after)), keys
    return "|".join((built, last, "@", "tiny?" if len(found) <= 2 and len(bare) < 40 else "?", after)), keys


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        real, made, inside = [], [], []
        for h, source, text in zip(batch["h"], batch["source"], batch["text"]):
            real.append(sketch(source or "", text))
            at = 1 + (int(h) & 0x7FFFFFFF) % max(1, len(text) - 1)  # anywhere but at the end
            made.append(sketch(source or "", text[:at]))
            inside.append(0 if text[at : at + 1].isalnum() else 1)
        columns = {f"{name}_{what}": [x[i] for x in rows] for name, rows in (("real", real), ("made", made)) for i, what in enumerate(("word", "keys"))}
        yield batch[["doc_id", "source", "limit_key", "h"]].assign(**columns, inside=inside)


def _word(name: str, own_end: Column, own_inner: Column, own_cut: Column) -> Column:
    """A sketch with what the counts of its keys tell filled in. What the text itself added to them, as an ending, inside or by its
    artificial cut, is taken out; other texts' endings count as whole as far as they exceed what cuts explain, chance included."""
    word, at = F.col(f"{name}_word"), lambda slot, what: F.coalesce(F.col("counts")[F.lit(f"{name}{slot}")][what], F.lit(0))
    texts = [F.greatest(F.lit(0), at(k, "texts") - own_end) for k in range(4)]
    inner = [F.greatest(F.lit(0), at(k, "total") - own_inner) for k in range(4)]
    cuts = [F.greatest(F.lit(0.0), at(k, "cuts") - own_cut) for k in range(3)]
    whole = [F.greatest(F.lit(0.0), texts[k] - cuts[k] - 2.5 * F.sqrt(cuts[k])) for k in range(3)]
    seen, ended = [inner[k] + whole[k] for k in (0, 1)], [at(k, "ends") + whole[k] for k in (0, 1)]
    often = F.when(seen[0] >= 3, seen[0]).otherwise(seen[1])
    share = F.when(seen[0] >= 3, ended[0] / seen[0]).when(seen[1] >= 3, ended[1] / seen[1]).otherwise(0.0)
    stop = F.when((often >= 20) & (share < 0.02), "never").otherwise("any")
    known = F.when(F.col(f"{name}_keys")[3].isNull(), "-").when((inner[3] + texts[3] >= 3) & (inner[3] >= 0.2 * texts[3]), "known").otherwise("odd")
    ends = F.when(F.col(f"{name}_keys")[2].isNotNull() & (at(2, "ends") + whole[2] >= 3), "line").when(word.contains("tiny?"), "tiny").when(share < 0.15, "low").when(share < 0.6, "mid").otherwise("high")
    filled = F.replace(F.replace(F.replace(word, F.lit("tiny?"), F.lit("?")), F.lit("?"), F.when(word.contains("@"), ends).otherwise(stop)), F.lit("@"), known)
    return F.when(word.contains("?"), filled).otherwise(word)


def describe(texts: DataFrame) -> DataFrame:
    """(doc_id, source, limit_key, real, made): the endings of texts (doc_id, source, limit_key, h, text) and of one artificial cut of each."""
    sketches = texts.mapInPandas(_sketches, "doc_id bigint, source string, limit_key string, h bigint, real_word string, real_keys array<bigint>, made_word string, made_keys array<bigint>, inside int")
    sketches = materialize(sketches.withColumn("row", F.monotonically_increasing_id()))
    slots = [F.struct(F.lit(f"{name}{k}").alias("slot"), F.when(F.col(f"{name}_word").contains("?"), F.col(f"{name}_keys")[k]).alias("key")) for name in ("real", "made") for k in range(4)]
    asked = sketches.select("row", F.explode(F.array(*slots)).alias("s")).select("row", "s.*").where("key IS NOT NULL")
    shares = cut_shares(sketches)
    told = asked.join(corpus_counts(sketches, texts, shares), "key").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct("total", "ends", "texts", "cuts")))).alias("counts"))
    off = F.when(F.col("limit_key") == "off", 1).otherwise(0)
    known = sketches.join(told, "row", "left").join(broadcast_if_small(shares, 200_000), F.col("source").eqNullSafe(F.col("share_of")), "left")
    return known.select("doc_id", "source", "limit_key", _word("real", off, F.lit(0), F.lit(0.0)).alias("real"), _word("made", F.lit(0), F.col("inside"), F.col("share")).alias("made"))


def _normal_sf(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def fit_censored(lengths: np.ndarray, counts: np.ndarray, limits: list[int], rounds: int = 30) -> tuple[float, float, dict[int, float]]:
    """(mu, sigma, limit -> censoring posterior) of a log-normal with right-censoring at the limits, by EM.

    Values off the limits are whole; a value at a limit is censored with the limit's posterior, which weighs the mass the
    distribution holds beyond the limit (times the share of texts exposed to it) against its density there.
    """
    x, w = np.log(lengths.astype(float)), counts.astype(float)
    at = np.isin(lengths, limits)
    mu = float(np.average(x, weights=w))
    sigma = max(0.05, float(np.sqrt(np.average((x - mu) ** 2, weights=w))))
    posterior = {limit: 0.9 for limit in limits}
    for _ in range(rounds):
        r = np.array([posterior[n] if a else 0.0 for n, a in zip(lengths, at)])
        z = (x - mu) / sigma
        sf = np.array([max(_normal_sf(v), 1e-12) for v in z])
        pdf = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
        hazard = pdf / sf
        m1 = np.where(at, r * (mu + sigma * hazard) + (1 - r) * x, x)  # expected log length
        m2 = np.where(at, r * (mu * mu + sigma * sigma + sigma * hazard * (x + mu)) + (1 - r) * x * x, x * x)
        mu = float(np.average(m1, weights=w))
        sigma = max(0.05, math.sqrt(max(1e-4, float(np.average(m2, weights=w)) - mu * mu)))
        for limit in limits:
            i = int(np.flatnonzero(lengths == limit)[0])
            beyond = float(w[lengths > limit].sum())
            censored = w[i] * posterior[limit]
            exposed = censored / max(1e-9, censored + beyond)
            z0 = (math.log(limit) - mu) / sigma
            mass = _normal_sf(z0) * exposed
            density = math.exp(-0.5 * z0 * z0) / (math.sqrt(2 * math.pi) * sigma * limit) * (1 - exposed)
            posterior[limit] = mass / max(1e-12, mass + density)
    return mu, sigma, posterior


LEAST = 5


def candidate_limits(lengths: np.ndarray, counts: np.ndarray, least: int = LEAST, excess: float = 4.0) -> list[int]:
    """Lengths at least ``least`` times there and ``excess`` times as frequent as lengths nearby (within a tenth, itself left out).

    Lengths that are no whole numbers stand for several merged ones: they count as nearby and are never limits themselves.
    """
    order = np.argsort(lengths)
    n, c = lengths[order], counts[order].astype(float)
    total = np.append(0, np.cumsum(c))
    out = []
    for i in np.flatnonzero((c >= least) & (n == np.floor(n))):
        width = max(5, int(0.1 * n[i]))
        lo, hi = np.searchsorted(n, n[i] - width), np.searchsorted(n, n[i] + width, side="right")
        near = (total[hi] - total[lo] - c[i]) / (2 * width)
        if c[i] >= excess * (near + 0.5) and n[i] >= 20:
            out.append(int(n[i]))
    return out


LIMITS = "source string, unit string, length bigint, documents bigint, posterior double, mu double, sigma double"


def _limits(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    lengths, counts = frame["length"].to_numpy(), frame["n"].to_numpy()
    found = candidate_limits(lengths, counts)
    mu, sigma, posterior = fit_censored(lengths, counts, found)
    size = dict(zip(lengths.tolist(), counts.tolist()))
    rows = [(*key, limit, size[limit], p, mu, sigma) for limit, p in posterior.items()] or [(*key, None, None, None, mu, sigma)]
    return pd.DataFrame(rows, columns=["source", "unit", "length", "documents", "posterior", "mu", "sigma"]).astype({"length": "Int64", "documents": "Int64"})


def length_limits(docs: DataFrame) -> DataFrame:
    """(source, unit, length, documents, posterior, mu, sigma): the candidate limits of each source, in characters or bytes.

    Only the histogram of lengths is grouped per source. Lengths seen often enough to be a limit are exact at every size; above
    100,000 the rarer ones are merged by the thousand, at half a length past the middle, where no text's length lies.
    A source without limits has one row per unit with a null length.
    """
    units = F.explode(F.array(F.struct(F.lit("char").alias("unit"), F.col("n_char").alias("length")), F.struct(F.lit("byte").alias("unit"), F.col("n_byte").alias("length"))))
    exact = docs.select("source", units.alias("u")).groupBy("source", F.col("u.unit").alias("unit"), F.col("u.length").alias("length")).agg(F.count("*").alias("n"))
    rare = (F.col("length") > 100_000) & (F.col("n") < LEAST)
    place = F.when(rare, F.floor(F.col("length") / 1000) * 1000 + 500.5).otherwise(F.col("length")).cast("double")
    hist = exact.groupBy("source", "unit", place.alias("length")).agg(F.sum("n").alias("n"))
    return hist.groupBy("source", "unit").applyInPandas(_limits, LIMITS)


def add_traces(made: Counter, share: float = 0.3) -> None:
    """Artificial cuts leave no trace of the cutting; give each kind of trace its share, generously: only excess counts as whole."""
    total = sum(made.values())
    for name, n in list(made.items()):
        if name.endswith("|plain"):
            made[name[: -len("plain")] + "ellipsis"] += share * n
    made["marker"] += share * total
    made["broken"] += share * total


def share_of_cuts(seen: dict[str, float], cut: dict[str, float], quantile: float = 0.6) -> float:
    """The share of cuts that ``seen`` leaves room for: a quantile, weighted by ``cut``, of the features' ratio seen to cut.

    Most of what cuts look like is rare among whole texts, so there the ratio is the share of cuts itself.
    """
    total = max(1.0, sum(seen.values()))
    ratios = sorted(((seen.get(f, 0.0) + 0.25) / total / p, p) for f, p in cut.items() if p > 0 and f.endswith("|plain"))
    left = quantile * sum(p for _, p in ratios)
    for ratio, p in ratios:
        left -= p
        if left <= 0:
            return min(0.5, max(0.002, ratio))
    return 0.03


def fit_mixture(real: dict[str, dict[str, float]], made: dict[str, float], start: dict[str, float], base_whole: dict[str, float], base_cut: dict[str, float], kappa: float = 20.0, rounds: int = 8):
    """((limit_key, features) -> posterior of a cut, limit_key -> rate, features -> share among whole texts).

    The cut component comes from the artificial cuts; the whole one starts as what the endings off the limits hold beyond
    their share of cuts and follows by EM. Both are smoothed towards the ``base`` distributions with weight ``kappa``.
    """
    names = sorted({f for c in real.values() for f in c} | set(made))
    cut_total, floor = sum(made.values()), 1e-6
    p_cut = {f: (made.get(f, 0.0) + kappa * base_cut.get(f, floor)) / (cut_total + kappa) for f in names}
    off = real.get("off", {})
    n_off, rate = sum(off.values()), dict(start)
    trust = n_off / (n_off + 200)  # a source of few texts leans on what holds for all
    rate["off"] = trust * share_of_cuts(off, p_cut) + (1 - trust) * start.get("off", 0.03)

    # Endings that no other source's whole texts have need a tenfold excess over what cuts explain.
    times = {f: 1 if "|tiny|" in f else 2 if base_whole.get(f, 0.0) > 1e-4 else 10 if base_whole else 3 for f in names}

    def whole_share(key: str, prior: dict[str, float], weight: float) -> dict[str, float]:
        # Mass is given to whole texts only where far more is seen than cuts explain, chance included: most endings are of one kind.
        n = sum(real.get(key, {}).values())
        rest = {}
        for f in names:
            cut = rate.get(key, 0.0) * p_cut[f] * n
            rest[f] = max(0.0, real.get(key, {}).get(f, 0.0) - times[f] * cut - 2.5 * math.sqrt(cut + 0.25))
        total = max(sum(rest.values()), n * (1 - rate.get(key, 0.0)))
        return {f: (rest[f] + weight * prior.get(f, floor)) / (total + weight) for f in names}

    first, post = dict(rate), {}
    for _ in range(rounds):
        whole = {"off": whole_share("off", base_whole, kappa)}
        for key, c in real.items():
            if key not in whole:
                whole[key] = whole_share(key, whole["off"], 5.0)
            cut = 0.0
            for f, n in c.items():
                a, b = rate[key] * p_cut[f], (1 - rate[key]) * whole[key][f]
                post[key, f] = a / max(a + b, 1e-300)
                cut += n * post[key, f]
            rate[key] = min(0.995, max(0.001, (cut + first[key]) / (sum(c.values()) + 1)))
    return post, rate, whole["off"]


def truncated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", threshold: float = 0.5) -> DataFrame:
    """One row per document with text: (doc_id, source, limit_key, ending, posterior, truncated).

    ``limit_key`` names the limit the length lies at (``char:100``; ``off`` for none), ``ending`` its features, ``posterior``
    the probability that the text was cut. Null, empty and blank texts have no row; a null or blank source is a source of its
    own; repeated texts are judged alike, each under its own id; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), source_key(F.col(source)).alias("source"), F.col(text).alias("text")).where(F.col("text").rlike(r"\S"))
    sized = rows.withColumns({"n_char": F.length("text"), "n_byte": F.octet_length("text")})
    limits = written(length_limits(sized).where("posterior > 0.3").select("source", "unit", "length", "posterior"))
    near = broadcast_if_small(limits, 200_000)  # a few dozen bytes a row; with it no text is exchanged
    by_char = near.where("unit = 'char'").select(F.col("source").alias("cs"), F.col("length").alias("cl"), F.col("posterior").alias("cp"))
    by_byte = near.where("unit = 'byte'").select(F.col("source").alias("bs"), F.col("length").alias("bl"), F.col("posterior").alias("bp"))
    at = (
        sized.join(by_char, F.col("source").eqNullSafe(F.col("cs")) & (F.col("n_char") == F.col("cl")), "left")
        .join(by_byte, F.col("source").eqNullSafe(F.col("bs")) & (F.col("n_byte") == F.col("bl")), "left")
        .withColumn("limit_key", F.when(F.col("cl").isNotNull(), F.concat(F.lit("char:"), "cl")).when(F.col("bl").isNotNull(), F.concat(F.lit("byte:"), "bl")).otherwise("off"))
    )
    described = materialize(describe(at.select("doc_id", "source", "limit_key", F.xxhash64("text").alias("h"), "text")))
    real = described.groupBy("source", "limit_key", F.col("real").alias("ending")).agg(F.count("*").alias("n"))
    made = described.groupBy("source", F.lit("made").alias("limit_key"), F.col("made").alias("ending")).agg(F.count("*").alias("n"))
    tally = materialize(real.unionByName(made))

    overall = tally.groupBy((F.col("limit_key") == "made").alias("made"), (F.col("limit_key") == "off").alias("off"), "ending").agg(F.sum("n").alias("n")).collect()
    base_cut, base_off, base_at = Counter(), Counter(), Counter()
    for r in overall:  # as many rows as there are feature words
        (base_cut if r["made"] else base_off if r["off"] else base_at)[r["ending"]] += r["n"]
    add_traces(base_cut)
    cut0 = {k: v / max(1.0, sum(base_cut.values())) for k, v in base_cut.items()}
    _, rate0, whole0 = fit_mixture({"off": dict(base_off), "at": dict(base_at)}, dict(base_cut), {"off": 0.03, "at": 0.8}, {}, {})

    def per_source(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        real: dict[str, dict[str, float]] = {}
        made: Counter = Counter()
        for limit, ending, n in zip(frame["limit_key"], frame["ending"], frame["n"]):
            if limit == "made":
                made[ending] += n
            else:
                real.setdefault(limit, {})[ending] = n
        add_traces(made)
        first = {k: frame.loc[frame["limit_key"] == k, "posterior"].max() for k in real}
        first = {k: rate0["off"] if k == "off" or not v == v else min(0.99, float(v)) for k, v in first.items()}
        post, rate, _ = fit_mixture(real, dict(made), first, whole0, cut0)
        return pd.DataFrame([(key[0], k, f, p, rate[k]) for (k, f), p in post.items()], columns=["source", "limit_key", "ending", "posterior", "rate"])

    known = limits.select("source", F.concat_ws(":", "unit", "length").alias("limit_key"), "posterior")
    known = tally.join(known, tally["source"].eqNullSafe(known["source"]) & (tally["limit_key"] == known["limit_key"]), "left").select(tally["*"], "posterior")
    scores = known.groupBy("source").applyInPandas(per_source, "source string, limit_key string, ending string, posterior double, rate double")
    scores = materialize(scores).select(F.col("source").alias("ss"), F.col("limit_key").alias("sl"), F.col("ending").alias("se"), "posterior")
    return (
        described.join(scores, F.col("source").eqNullSafe(F.col("ss")) & (F.col("limit_key") == F.col("sl")) & (F.col("real") == F.col("se")), "left")
        .select("doc_id", "source", "limit_key", F.col("real").alias("ending"), "posterior", (F.col("posterior") > threshold).alias("truncated"))
    )


def truncation_rates(judged: DataFrame) -> DataFrame:
    """(source, documents, truncated, rate, expected_rate): how often each source cuts its texts off."""
    return judged.groupBy("source").agg(
        F.count("*").alias("documents"),
        F.count_if("truncated").alias("truncated"),
        F.avg(F.col("truncated").cast("int")).alias("rate"),
        F.avg("posterior").alias("expected_rate"),
    )
