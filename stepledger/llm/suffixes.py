"""Suffix-array dedup over bytes: common prefixes of ``width`` bytes or more, from Burrows-Wheeler transforms.

What a transform sees. Every window of ``width`` bytes has a minimizer: of its pieces of ``ANCHOR`` bytes the one with the least
hash. Neighbouring windows with one minimizer form a *fragment*. Equal windows have equal minimizers, so only fragments of
one minimizer, a *class*, have to meet. A block sends shards the hashes of its distinct fragments. Fragments that occur more
than once are repeated as a whole; classes of one fragment are done. Only one text of each fragment of the other
classes travels, to a shard that transforms it together with its class.

What it does there. Suffixes are sorted, and the transform is extended backwards, breadth first: where two neighbouring
suffixes part after ``n`` bytes, each byte that precedes both sides gives a pair that parts after ``n + 1``. So common prefixes
come up by increasing value; the expansion stops at ``width``, and all neighbours that are left share at least that much.

A class of so many different fragments that one transform can't hold it (see ``CLASS_BYTES``) is decided by 128-bit
hashes of its windows instead, spread over all shards; that is as exact, and no task holds the class.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stepledger.llm import blocks as B
from stepledger.llm.rolling import SLICE, Rolling, byte_values, tables

#: Bytes of a minimizer, of text that a transform of several classes takes, and of the largest class that is transformed.
ANCHOR, TRANSFORM_BYTES, CLASS_BYTES = 64, 1 << 16, 1 << 18
_PLACE_BITS = np.uint64(21)  # of a place within a slice and its overlap

_ASK = "shard int, block int, first binary, second binary, several binary"
_CODE = "block int, shard int, code binary"
_MESSAGE = "shard int, block int, kind int, first binary, second binary, third binary, several binary"
_ANSWER = "block int, shard int, kind int, first binary, second binary, third binary, several binary"
#: Kinds of messages: places that only pass through, fragments for a transform, hashes of windows.
_PLACES, _FRAGMENTS, _WINDOWS = 0, 1, 2
#: Answers about a fragment: all of it is repeated; its text is wanted; its windows' hashes are wanted.
_REPEATED, _SHIP, _HASH = 1, 2, 4


#: Symbols that one sort key holds, and bits of a symbol.
_PACKED, _SYMBOL_BITS = 7, 9


def _keys(symbols: np.ndarray) -> np.ndarray:
    """The next symbols of every suffix in one number, zeros beyond the end."""
    n = len(symbols)
    key = np.zeros(n, np.uint64)
    for k in range(_PACKED):
        key = (key << np.uint64(_SYMBOL_BITS)) | np.append(symbols[k:], np.zeros(min(k, n), symbols.dtype)).astype(np.uint64)[:n]
    return key


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes of small non-negative numbers (below 512), by doubling the sorted length."""
    n = len(symbols)
    key = _keys(symbols)
    order = np.argsort(key)
    new = np.append(True, key[order][1:] != key[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    length = _PACKED
    while not new.all():
        # Ranks are first places of groups of equal suffixes; only groups of several are sorted again.
        at = np.flatnonzero(~(new & np.append(new[1:], True)))
        rows = order[at]
        after = np.where(rows + length < n, rank[np.minimum(rows + length, n - 1)] + 1, 0)
        both = rank[rows] * (n + 1) + after
        again = np.argsort(both)
        rows, both = rows[again], both[again]
        order[at] = rows
        new[at] |= np.append(True, both[1:] != both[:-1])
        rank[rows] = np.maximum.accumulate(np.where(new[at], at, 0))
        length *= 2
    return order


def _shared_symbols(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many symbols two keys have in common, up to the first zero, which equals nothing."""
    shared, going = np.zeros(len(one), np.int64), np.ones(len(one), bool)
    for k in range(_PACKED):
        shift, mask = np.uint64(_SYMBOL_BITS * (_PACKED - 1 - k)), np.uint64((1 << _SYMBOL_BITS) - 1)
        symbol = (one >> shift) & mask
        going &= (symbol == (other >> shift) & mask) & (symbol > 0)
        shared += going
    return shared


def shared_starts(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text the starts of windows of ``width`` bytes that occur in another place of these texts too."""
    sizes = np.array([len(x) for x in texts], np.int64)
    symbols = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes + 1) - 1
    symbols[ends] = 0  # what stands between texts is no byte
    n = len(symbols)
    order = suffix_array(symbols)
    before = symbols[order - 1]
    letters, counts = np.unique(symbols, return_counts=True)
    first = (np.cumsum(counts) - counts)[1:].astype(np.int32)
    smaller = np.zeros((len(first), n + 1), np.int32)
    for row, letter in enumerate(letters[1:]):
        np.cumsum(before == letter, out=smaller[row, 1:])
    # Does a suffix part from the one before it, after fewer bytes than so far? The sort keys tell for the first few bytes.
    key = _keys(symbols)
    known, depth = np.zeros(n, np.int64), 0
    while depth < min(3 * _PACKED, width):
        deep = np.flatnonzero(known == depth)
        deep = deep[deep > 0]
        here, there = (key[np.minimum(order[deep - k] + depth, n - 1)] for k in (0, 1))
        known[deep] += _shared_symbols(here, there)
        depth += _PACKED
    begun = min(depth, width) - 1
    parted = np.append(known <= begun, True)
    frontier = np.flatnonzero(np.append(known == begun, False))
    for _ in range(begun + 1, width):
        found = (first[:, None] + smaller[:, frontier]).ravel()
        frontier = np.unique(found[~parted[found]])
        if not len(frontier):
            break
        parted[frontier] = True
    same = ~parted
    places = np.sort(order[same[:-1] | same[1:]])
    owner = np.searchsorted(ends, places)
    begins = ends - sizes
    fits = places + width <= ends[owner]
    return _split(places[fits], owner[fits], begins)


def _split(places: np.ndarray, owner: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
    edges = np.searchsorted(owner, np.arange(len(begins) + 1))
    return [places[a:b] - begin for a, b, begin in zip(edges, edges[1:], begins, strict=False)]


def _stretches(starts: np.ndarray, width: int) -> np.ndarray:
    """Rows ``(begin, end)``: the bytes that windows at the ascending ``starts`` cover, joined where starts follow each other."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(starts) > 1)
    return np.stack([starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + width], axis=1).astype(np.int64)


class _Bytes:
    """The bytes of a block's documents, one after the other, with one byte between them that no window may hold."""

    def __init__(self, block: B.Block) -> None:
        self.texts = list(block.texts())
        self.raw = b"\0".join([*self.texts, b""])
        self.letters = np.frombuffer(self.raw, np.uint8)
        sizes = np.array([len(x) for x in self.texts], np.int64)
        self.ends = np.cumsum(sizes + 1) - 1
        self.begins = self.ends - sizes
        self.one, self.two = tables()

    def fragments(self, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, last window and minimizer's place of every fragment."""
        found = []
        whole = np.zeros(len(self.letters) + 1, np.int32)  # +1 where windows begin to fit, -1 where they no longer do
        fits = self.ends - self.begins >= width
        whole[self.begins[fits]] += 1
        whole[self.ends[fits] - width + 1] -= 1
        whole = np.cumsum(whole[:-1]) > 0
        span = width - anchor + 1
        for a in range(0, len(self.letters) - width + 1, SLICE):
            part = byte_values(self.letters[a : a + SLICE + width - 1])
            at = np.arange(len(part) - anchor + 1)
            # The least hash of a window, the first of equal ones: the place stands in the lowest bits.
            least = ((self.one.pieces(part, at, at + anchor) >> _PLACE_BITS) << _PLACE_BITS) | at.astype(np.uint64)
            size = 1
            while size * 2 <= span:
                least = np.minimum(least[:-size], least[size:])
                size *= 2
            if span > size:
                least = np.minimum(least[: size - span], least[span - size :])
            place = (least & np.uint64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64) + a
            valid = np.flatnonzero(whole[a : a + len(place)])
            if len(valid):
                own = place[valid]
                turn = np.flatnonzero((np.diff(own) != 0) | (np.diff(valid) != 1))
                firsts, lasts = valid[np.append(0, turn + 1)] + a, valid[np.append(turn, len(valid) - 1)] + a
                found.append(np.stack([firsts, lasts, place[lasts - a]]))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        firsts, lasts, places = np.concatenate(found, axis=1)
        # A fragment that the end of a slice has cut becomes one again.
        joins = np.append((places[1:] == places[:-1]) & (firsts[1:] == lasts[:-1] + 1), False)
        begin = ~np.append(False, joins[:-1])
        return firsts[begin], lasts[~joins], places[begin]

    def hashes(self, rolling: Rolling, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each ascending stretch; none is longer than the overlap of the tables."""
        out = np.empty(len(starts), np.uint64)
        for a in range(0, len(self.letters), SLICE):
            here = slice(*np.searchsorted(starts, (a, a + SLICE)))
            if here.start < here.stop:
                part = byte_values(self.letters[a : a + SLICE + rolling.longest])
                out[here] = rolling.pieces(part, starts[here] - a, ends[here] - a)
        return out


class _Fragments:
    """The fragments of a block with their class and content hashes, and the distinct ones among them."""

    def __init__(self, own: _Bytes, width: int, anchor: int) -> None:
        self.firsts, self.lasts, places = own.fragments(width, anchor)
        kind = own.hashes(own.one, places, places + anchor)
        content = own.hashes(own.two, self.firsts, self.lasts + width)
        order = np.lexsort((content, kind))
        a, b = kind[order], content[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.kind, self.content, self.example = a[new], b[new], order[new]
        self.of = np.zeros(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.several = (np.bincount(self.of, minlength=len(self.kind)) > 1).astype(np.uint8)


def _codes(first: np.ndarray, second: np.ndarray, several: np.ndarray, most: int) -> np.ndarray:
    """What a shard wants of each entry."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new_class = np.append(True, a[1:] != a[:-1])[: len(order)]
    new = new_class | np.append(True, b[1:] != b[:-1])[: len(order)]
    fragment = np.cumsum(new) - 1
    weight = np.bincount(fragment, weights=several[order].astype(np.float64) + 1)
    repeated = weight > 1
    in_class = (np.cumsum(new_class) - 1)[new]
    distinct = np.bincount(in_class)
    unlike = np.bincount(in_class, weights=~repeated) > 0
    meet = (distinct > 1) & unlike
    want = np.where(meet, np.where(distinct <= most, _SHIP, _HASH), 0)[in_class]
    out = np.zeros(len(order), np.uint8)
    out[order] = np.where(repeated, _REPEATED, 0)[fragment] | np.where(new, want[fragment], 0)
    return out


def dedup_byte_strings(docs: DataFrame, width: int = 400, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, text, n_bytes, n_removed, n_spans, kept_sha256, row``: per row, the bytes that no repeated string covers.

    A string of ``width`` UTF-8 bytes is repeated if it also starts anywhere else, in the same row or another (rows with
    equal ids are different places). ``text`` is what stays as binary, since a cut may fall inside a character. Null texts
    are empty. ``row`` has all columns of the input.
    """
    if not 0 < anchor <= width or 2 * width > 1 << 12:
        raise ValueError("the anchor must fit the width, and two widths the tables")
    total = B.text_bytes(docs)
    shards = B.parts(total, B.SHARD_BYTES)
    placed = B.dealt(docs, B.parts(total, B.BLOCK_BYTES))
    most = CLASS_BYTES // (2 * width)  # fragments of a class that surely fit one transform

    def shard_of(keys: np.ndarray) -> np.ndarray:
        return (keys % np.uint64(shards)).astype(np.int64)

    def ask(table: pa.Table) -> pa.Table:
        block = B.Block(table)
        own = _Fragments(_Bytes(block), width, anchor)
        return B.send(block.number, shard_of(own.kind), {"first": own.kind, "second": own.content, "several": own.several})

    def code(messages: pa.Table) -> pa.Table:
        first, second = B.joined(messages, "first", np.uint64), B.joined(messages, "second", np.uint64)
        return B.cut(messages, _codes(first, second, B.joined(messages, "several", np.uint8), most), "code", 1, "several")

    def ship(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = B.Block(table)
        text = _Bytes(block)
        own = _Fragments(text, width, anchor)
        codes = B.received(answers, "code", np.uint8, shard_of(own.kind))
        out = []
        wanted = np.flatnonzero(codes & _SHIP)
        if len(wanted):
            out += _shipped(block.number, text, own, codes, wanted)
        wanted = np.flatnonzero(codes & _HASH)
        at = np.concatenate([np.arange(own.firsts[k], own.lasts[k] + 1) for k in np.sort(own.example[wanted])] or [np.zeros(0, np.int64)])
        # A fragment that is repeated as a whole is there for the others' sake.
        first, second = text.hashes(text.one, at, at + width), text.hashes(text.two, at, at + width)
        order = np.lexsort((second, first))
        new = np.ones(len(order), bool)
        new[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
        back = np.zeros(len(order), np.int32)
        back[order] = np.cumsum(new) - 1
        keys = order[new]
        if len(keys):
            several = (np.bincount(back) > 1).astype(np.uint8)
            sent = B.send(block.number, shard_of(first[keys]), {"first": first[keys], "second": second[keys], "several": several})
            out.append(_message(sent, _WINDOWS))
        whole = (codes & _REPEATED)[own.of] > 0
        covered = _joined(np.stack([own.firsts[whole], own.lasts[whole] + width], axis=1))
        passing = {
            "shard": pa.array([block.number % shards], pa.int32()),
            "block": pa.array([block.number], pa.int32()),
            "first": pa.array([covered.tobytes()], pa.binary()),
            "second": pa.array([at.astype(np.int64).tobytes()], pa.binary()),
            "third": pa.array([back.tobytes()], pa.binary()),
            "several": pa.array([shard_of(first[keys]).astype(np.int32).tobytes()], pa.binary()),
        }
        out.append(_message(pa.table(passing), _PLACES))
        return pa.concat_tables(out)

    def _shipped(number: int, text: _Bytes, own: _Fragments, codes: np.ndarray, wanted: np.ndarray) -> list[pa.Table]:
        example = own.example[wanted]
        begins, ends = own.firsts[example], own.lasts[example] + width
        asked = (codes[wanted] & _REPEATED) == 0
        facts = np.stack([begins, ends - begins, asked.astype(np.int64)], axis=1)
        to = shard_of(own.kind[wanted])
        sent = B.send(number, to, {"first": own.kind[wanted], "second": facts})
        texts = [b"".join(text.raw[a:b] for a, b in zip(begins[to == s], ends[to == s], strict=True)) for s in np.unique(to)]
        return [_message(sent.append_column("third", pa.array(texts, pa.binary())), _FRAGMENTS)]

    def decide(messages: pa.Table) -> pa.Table:
        kinds = np.array(messages["kind"].to_pylist())
        passing = messages.filter(pa.array(kinds == _PLACES)).select(["block", "shard", "kind", "first", "second", "third", "several"])
        out = [passing]
        fragments = messages.filter(pa.array(kinds == _FRAGMENTS))
        if fragments.num_rows:
            out.append(_transformed(fragments, width))
        windows = messages.filter(pa.array(kinds == _WINDOWS))
        if windows.num_rows:
            first, second = B.joined(windows, "first", np.uint64), B.joined(windows, "second", np.uint64)
            hit = B.repeated(first, second, B.joined(windows, "several", np.uint8)).astype(np.uint8)
            out.append(_message(B.cut(windows, hit, "first", 1, "several"), _WINDOWS).select(passing.column_names))
        return pa.concat_tables(out)

    def rebuild(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = B.Block(table)
        text = _Bytes(block)
        change = np.zeros(len(text.raw) + 1, np.int32)
        kinds = np.array(answers["kind"].to_pylist())
        for kind, value in zip(kinds, answers["first"].to_pylist(), strict=True):
            if kind != _WINDOWS and value:
                spans = np.frombuffer(value, np.int64).reshape(-1, 2)
                np.add.at(change, spans[:, 0], 1)
                np.add.at(change, spans[:, 1], -1)
        windows = answers.filter(pa.array(kinds == _WINDOWS))
        if windows.num_rows:
            passing = answers.filter(pa.array(kinds == _PLACES)).to_pylist()[0]
            hit = B.received(windows, "first", np.uint8, np.frombuffer(passing["several"], np.int32))
            at = np.frombuffer(passing["second"], np.int64)
            starts = at[hit[np.frombuffer(passing["third"], np.int32)] > 0]
            np.add.at(change, starts, 1)
            np.add.at(change, starts + width, -1)
        gone = np.cumsum(change[:-1]) > 0
        kept, n_removed, n_spans = [], [], []
        for own, a, b in zip(text.texts, text.begins.tolist(), text.ends.tolist(), strict=True):
            mask = gone[a:b]
            n_removed.append(int(mask.sum()))
            n_spans.append(int(mask[:1].sum()) + int((mask[1:] & ~mask[:-1]).sum()) if n_removed[-1] else 0)
            kept.append(text.letters[a:b][~mask].tobytes() if n_removed[-1] else own)
        return pa.table(
            {
                "doc_id": block.column("doc_id").cast(pa.int64()),
                "text": pa.array(kept, pa.binary()),
                "n_bytes": pa.array([len(x) for x in text.texts], pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "n_spans": pa.array(n_spans, pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                "row": block.rows,
            }
        )

    codes = B.per_shard(B.per_block(placed, ask, _ASK), code, _CODE)
    found = B.per_shard(B.with_answers(placed, codes, ship, _MESSAGE), decide, _ANSWER)
    schema = B.with_row("doc_id bigint, text binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", placed)
    return B.with_answers(placed, found, rebuild, schema)


def _message(table: pa.Table, kind: int) -> pa.Table:
    """With all columns of a message, in their order."""
    empty = pa.array([b""] * table.num_rows, pa.binary())
    columns = {n: table[n] if n in table.column_names else empty for n in ("first", "second", "third", "several")}
    return pa.table({"shard": table["shard"], "block": table["block"], "kind": pa.array([kind] * table.num_rows, pa.int32()), **columns})


def _joined(spans: np.ndarray) -> np.ndarray:
    """Ascending spans, those that touch made one."""
    if not len(spans):
        return spans.astype(np.int64)
    cut = np.flatnonzero(spans[1:, 0] > spans[:-1, 1])
    return np.stack([spans[np.append(0, cut + 1), 0], spans[np.append(cut, len(spans) - 1), 1]], axis=1).astype(np.int64)


def _transformed(messages: pa.Table, width: int) -> pa.Table:
    """Spans of the fragments that were asked about, from transforms of whole classes, several small classes in one."""
    classes: dict[int, list[tuple[int, int, bytes]]] = {}
    for number, message in enumerate(messages.select(["first", "second", "third"]).to_pylist()):
        facts = np.frombuffer(message["second"], np.int64).reshape(-1, 3)
        at = 0
        for kind, (begin, size, asked) in zip(np.frombuffer(message["first"], np.uint64).tolist(), facts.tolist(), strict=True):
            classes.setdefault(kind, []).append((number, begin if asked else -1, message["third"][at : at + size]))
            at += size
    spans: list[list[np.ndarray]] = [[] for _ in range(messages.num_rows)]

    def transform(members: list[tuple[int, int, bytes]]) -> None:
        for (number, begin, _), starts in zip(members, shared_starts([x for *_, x in members], width), strict=True):
            if begin >= 0 and len(starts):
                spans[number].append(_stretches(starts, width) + begin)

    waiting, held = [], 0
    for members in classes.values():
        size = sum(len(x) + 1 for *_, x in members)
        if waiting and held + size > TRANSFORM_BYTES:
            transform(waiting)
            waiting, held = [], 0
        waiting, held = waiting + members, held + size
    transform(waiting)
    found = [np.concatenate(x).astype(np.int64).tobytes() if x else b"" for x in spans]
    answered = pa.table({"shard": messages["shard"], "block": messages["block"], "first": pa.array(found, pa.binary())})
    return _message(answered, _FRAGMENTS).select(["block", "shard", "kind", "first", "second", "third", "several"])
