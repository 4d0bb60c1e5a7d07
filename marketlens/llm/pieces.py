"""SentencePiece encoding and decoding that keeps where each piece comes from in the original bytes.

A text is normalised by the longest prefixes that the model's compiled character map knows; every normalised
character records the byte of the text that it comes from.  The normalised text is cut where no piece of the
vocabulary can cross, the parts are merged by the scores of the pieces, and each piece is projected back to a span
of original bytes.  Ids, spans and decoded texts are those of the ``sentencepiece`` library for a BPE model with or
without byte fallback; models of another kind, with pieces that users defined or that are unused, or with white space
as a suffix raise ``ValueError``.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.shingles import runs

#: Fixed value: the character that stands for a blank.
BLANK = "▁"
#: Bytes of text that are encoded before their rows are handed on; a longer text is alone.
_ROOM = 1_500_000
#: Parts, and their pieces, that a worker remembers before it begins anew.
_PARTS, _PIECES = 250_000, 4_000_000
#: Parts of at most so many characters are merged in rows of a table, so many of them at a time.
_SHORT, _TOGETHER = 24, 20_000

_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a serialised message; values of fixed width stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = message[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(message):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
        yield number, message[at : at + size]
        at += size


class CharacterMap:
    """A compiled map of UTF-8 strings to their replacements: a double array and the replacements, each ended by a zero byte."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0]
        self._units = np.frombuffer(compiled, dtype="<u4", count=size // 4, offset=4).tolist()
        self._out = compiled[4 + size :]
        root = self._child_base(0)
        leads = bytes(b for b in range(1, 256) if root ^ b < len(self._units) and self._units[root ^ b] & 0x800000FF == b)
        ascii_leads = "".join(re.escape(chr(b)) for b in leads if b < 128)
        self.may_start = re.compile(f"[{ascii_leads}\x80-\U0010ffff]") if any(b > 127 for b in leads) else re.compile(f"[{ascii_leads}]") if leads else None

    def _child_base(self, node: int) -> int:
        unit = self._units[node]
        return node ^ (unit >> 10 << ((unit & 0x200) >> 6))

    def longest(self, data: bytes) -> tuple[int, str] | None:
        """How many bytes at the start of ``data`` the longest known prefix has, and what replaces it."""
        found, node = None, self._child_base(0)
        for n, b in enumerate(data):
            node ^= b
            if node >= len(self._units) or self._units[node] & 0x800000FF != b:
                break
            has_value, node = self._units[node] >> 8 & 1, self._child_base(node)
            if has_value:
                found = n + 1, self._units[node] & 0x7FFFFFFF
        return found and (found[0], self._out[found[1] : self._out.index(0, found[1])].decode())


#: Bytes of a text that a known prefix may have; the longest in use have some twenty.
_LONGEST_PREFIX = 64


class _Merges:
    """Merging of many short parts at once: a row of symbols for each part, of which every round joins one pair.

    Symbols are the pieces, and characters that only occur inside pieces.
    """

    def __init__(self, rank: dict[str, tuple[float, int]], alphabet: set[str]):
        self.symbols = [*rank, *sorted(alphabet - rank.keys())]
        code = {p: k for k, p in enumerate(self.symbols)}
        self._span = len(self.symbols) + 1  # the code before 0, which pads rows, makes no pair that is known
        order = {c: k for k, c in enumerate(sorted({cost for cost, _ in rank.values()}))}
        known = sorted((code[p[:i]] * self._span + code[p[i:]], order[cost], code[p]) for p, (cost, _) in rank.items() for i in range(1, len(p)) if p[:i] in code and p[i:] in code)
        self._keys, cost, made = (np.array(c, dtype=np.int64) for c in zip(*known, (np.iinfo(np.int64).max, 0, 0)))
        self._none = np.int32(len(order))
        self._cost, self._made = cost.astype(np.int32), made.astype(np.int32)
        self._of_char = np.full(max(map(ord, alphabet), default=0) + 1, -1, dtype=np.int32)
        for c in alphabet:
            self._of_char[ord(c)] = code[c]

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self._span + right
        at = np.searchsorted(self._keys, key)
        return np.where(self._keys[at] == key, self._cost[at], self._none), self._made[at]

    def merged(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all parts, behind each other, and how many each part has."""
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        chars = self._of_char[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        width = int(sizes.max(initial=1))
        rows = np.full((len(parts), width), -1, dtype=np.int32)
        rows[np.arange(width) < sizes[:, None]] = chars
        out = rows.copy()
        who = np.arange(len(parts))
        cost = self._look(rows[:, :-1], rows[:, 1:])[0]
        while cost.shape[1]:
            k = cost.argmin(axis=1)
            live = cost[np.arange(len(k)), k] < self._none
            out[who[~live], : rows.shape[1]] = rows[~live]
            out[who[~live], rows.shape[1] :] = -1
            rows, cost, who, k = rows[live], cost[live], who[live], k[live]
            n = np.arange(len(k))
            joined = self._look(rows[n, k], rows[n, k + 1])[1]
            columns = np.arange(rows.shape[1] - 1)
            rows = np.take_along_axis(rows, columns + (columns > k[:, None]), axis=1)
            rows[n, k] = joined
            columns = columns[:-1]
            cost = np.take_along_axis(cost, columns + (columns >= k[:, None]), axis=1)
            left, right = n[k > 0], n[k < cost.shape[1]]
            cost[left, k[left] - 1] = self._look(rows[left, k[left] - 1], rows[left, k[left]])[0]
            cost[right, k[right]] = self._look(rows[right, k[right]], rows[right, k[right] + 1])[0]
        out[who, : rows.shape[1]] = rows
        out[who, rows.shape[1] :] = -1
        return out[out >= 0], (out >= 0).sum(axis=1)


class _Known:
    """Parts that were met, by number; the pieces of part ``n`` lie in ``ids`` and ``sizes``, ``count[n]`` of them from ``begin[n]`` on."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.ids, self.sizes, self.begin, self.count = (np.zeros(0, dtype=np.int32) for _ in range(4))

    def add(self, which: np.ndarray, ids: np.ndarray, sizes: np.ndarray, count: np.ndarray) -> None:
        """The pieces of numbered parts, in any order."""
        more = np.zeros(max(0, int(which.max(initial=-1)) + 1 - len(self.begin)), dtype=np.int32)
        self.begin, self.count = np.concatenate((self.begin, more)), np.concatenate((self.count, more))
        self.begin[which], self.count[which] = len(self.ids) + np.cumsum(count) - count, count
        self.ids, self.sizes = (np.concatenate(c).astype(np.int32) for c in ((self.ids, ids), (self.sizes, sizes)))


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers ``begin, begin + 1, ...``, ``n`` of them for each begin."""
    return np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)


class PieceModel:
    """A model file's pieces and rules."""

    def __init__(self, serialized: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        kind, byte_fallback, suffix, self.unknown_surface = 1, False, False, " ⁇ "
        compiled, self.dummy_prefix, self.squeeze, self.escape = b"", True, True, True
        for number, value in _fields(serialized):
            if number == 1:
                p = dict(_fields(value))
                self.pieces.append(p.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                self.kinds.append(p.get(3, _NORMAL))
            elif number == 2:
                t = dict(_fields(value))
                kind, byte_fallback, suffix = t.get(3, 1), bool(t.get(35, 0)), bool(t.get(24, 0))
                self.unknown_surface = t.get(44, self.unknown_surface.encode()).decode()
            elif number == 3:
                r = dict(_fields(value))
                compiled, self.dummy_prefix, self.squeeze, self.escape = r.get(2, b""), bool(r.get(3, 1)), bool(r.get(4, 1)), bool(r.get(5, 1))
        if kind != 2 or suffix or not self.escape or set(self.kinds) - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("only BPE models with normal, unknown, control and byte pieces and escaped white space are known here")
        self.map = CharacterMap(compiled) if compiled else None
        self.rank = {p: (-s, i) for i, (p, s, k) in enumerate(zip(self.pieces, self.scores, self.kinds)) if k == _NORMAL}
        self.unknown = self.kinds.index(_UNKNOWN)
        self.byte_ids = [i for i, k in enumerate(self.kinds) if k == _BYTE] if byte_fallback else None
        pairs = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        alphabet = {c for pair in pairs for c in pair}
        # A part is a run of characters that pieces of several characters have.  Where a blank never follows another character inside a piece, it begins a part.
        inner = "".join(map(re.escape, sorted(alphabet - {BLANK})))
        self._parts = re.compile(f"{BLANK}*[{inner}]+|{BLANK}+|[^{inner}{BLANK}]" if all(b != BLANK or a == BLANK for a, b in pairs) else f"[{inner}{BLANK}]+|[^{inner}{BLANK}]")
        self._alphabet, self._merges = alphabet, _Merges(self.rank, alphabet)
        made = [self._named([p]) for p in self._merges.symbols]
        self._symbol_count = np.array([len(ids) for ids, _ in made])
        self._symbol_begin = np.cumsum(self._symbol_count) - self._symbol_count
        self._symbol_ids, self._symbol_sizes = (np.array([x for row in c for x in row], dtype=np.int32) for c in zip(*made))
        self._known = _Known()
        self._bytes = [self._surface(i) for i in range(len(self.pieces))]

    # Normalisation ----------------------------------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and the byte of the text that each of its characters, and its end, comes from."""
        sizes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        ends = np.cumsum(1 + (sizes > 0x7F) + (sizes > 0x7FF) + (sizes > 0xFFFF), dtype=np.int64)
        at = np.concatenate(([0], ends))
        first = self._leading_blanks(text) if self.squeeze else 0
        if self.map and self.map.may_start:
            text, at = self._mapped(text, at)
        if self.squeeze:
            blank = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4") == 32
            kept = np.flatnonzero(~(blank & np.concatenate(([True], blank[:-1]))))
            text, at = "".join(map(text.__getitem__, kept.tolist())), np.concatenate((at[kept], at[-1:]))
        if self.dummy_prefix:
            text, at = " " + text, np.concatenate(([first], at))
        text = text.replace(" ", BLANK)
        if self.squeeze and text.endswith(BLANK):
            text = text.rstrip(BLANK)
            at = at[: len(text) + 1]
        return text, at

    def _leading_blanks(self, text: str) -> int:
        """The bytes at the start of a text that are blanks, once each is normalised by itself."""
        at = size = 0
        while at < len(text):
            raw = text[at : at + _LONGEST_PREFIX].encode("utf-8", "surrogatepass")
            used, made = self.map.longest(raw) or (1, text[at]) if self.map else (1, text[at])
            if made != " ":
                break
            at, size = at + len(raw[:used].decode("utf-8", "surrogatepass")), size + used
        return size

    def _mapped(self, text: str, at: np.ndarray) -> tuple[str, np.ndarray]:
        parts, places, done = [], [], 0
        for m in self.map.may_start.finditer(text):
            k = m.start()
            if k < done:
                continue
            hit = self.map.longest(text[k : k + _LONGEST_PREFIX].encode("utf-8", "surrogatepass"))
            if hit is None:
                continue
            parts += [text[done:k], hit[1]]
            places += [at[done:k], np.full(len(hit[1]), at[k])]
            done = int(np.searchsorted(at, at[k] + hit[0]))
        return "".join([*parts, text[done:]]), np.concatenate([*places, at[done:]])

    # Encoding ---------------------------------------------------------------------------------------------------

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pieces of a text, and where the span of each begins and ends in the text's bytes."""
        return self.encode_all([text])[:3]

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, begins and ends of the pieces of all texts, and how many each text has."""
        normal, places = zip(*(self.normalise(t) if t else ("", np.zeros(1, dtype=np.int64)) for t in texts))
        number, n_parts = self._numbers(normal)
        n = self._known.count[number]
        at = _ranges(self._known.begin[number], n)
        ids, sizes = self._known.ids[at], self._known.sizes[at].astype(np.int64)
        text_of = np.repeat(np.repeat(np.arange(len(texts)), n_parts), n)
        if not self.byte_ids and len(ids):  # neighbouring unknown characters are one piece
            first = np.flatnonzero(np.concatenate(([True], (ids[1:] != self.unknown) | (ids[:-1] != self.unknown) | (text_of[1:] != text_of[:-1]))))
            ids, sizes, text_of = ids[first], np.add.reduceat(sizes, first), text_of[first]
        place, end = np.concatenate(places), np.cumsum(sizes) + text_of  # every text has one place more than characters
        return ids, place[end - sizes].astype(np.int32), place[end].astype(np.int32), np.bincount(text_of, minlength=len(texts))

    def _numbers(self, normal: tuple[str, ...]) -> tuple[np.ndarray, list[int]]:
        """Numbers of the parts of all normalised texts, and how many parts each has."""
        if len(self._known.number) > _PARTS or len(self._known.ids) > _PIECES:
            self._known = _Known()
        known = self._known.number
        first_new, new, out, n_parts = len(known), {}, [], []
        for text in normal:
            parts = self._parts.findall(text)
            found = list(map(known.get, parts))
            if None in found:
                for k, n in enumerate(found):
                    if n is None:
                        found[k] = new.setdefault(parts[k], first_new + len(new))
            out.append(np.array(found, dtype=np.int32))
            n_parts.append(len(parts))
        if new:
            self._learn(new)
            known.update(new)
        return np.concatenate(out), n_parts

    def _learn(self, new: dict[str, int]) -> None:
        quick = lambda p: len(p) <= _SHORT and (len(p) > 1 or p in self._alphabet)
        short = sorted(filter(quick, new), key=len)
        for k in range(0, len(short), _TOGETHER):
            some = short[k : k + _TOGETHER]
            symbols, count = self._merges.merged(some)
            n = self._symbol_count[symbols]
            at = _ranges(self._symbol_begin[symbols], n)
            self._known.add(np.array([new[p] for p in some]), self._symbol_ids[at], self._symbol_sizes[at], np.add.reduceat(n, np.cumsum(count) - count))
        rest = [p for p in new if not quick(p)]
        if rest:
            made = [self._merged(p) for p in rest]
            flat = (np.array([x for row in c for x in row], dtype=np.int32) for c in zip(*made))
            self._known.add(np.array([new[p] for p in rest]), *flat, np.array([len(i) for i, _ in made]))

    def _merged(self, part: str) -> tuple[list[int], list[int]]:
        """Ids of a part's pieces and how many characters each has: of neighbours whose union is a piece, the best score is joined first, leftmost among equals."""
        rank, n = self.rank, len(part)
        end = list(range(1, n + 1))  # a piece is known by the place of its first character
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        waiting = [(*r[:1], i, i + 1, 2) for i in range(n - 1) if (r := rank.get(part[i : i + 2]))]
        heapify(waiting)
        alive = [True] * n
        while waiting:
            _, left, right, size = heappop(waiting)
            if not alive[left] or not alive[right] or after[left] != right or end[right] - left != size:
                continue
            end[left], alive[right], after[left] = end[right], False, after[right]
            if after[left] < n:
                before[after[left]] = left
            for a, b in ((before[left], left), (left, after[left])):
                if a >= 0 and b < n and (r := rank.get(part[a : end[b]])):
                    heappush(waiting, (r[0], a, b, end[b] - a))
        merged, at = [], 0
        while at < n:
            merged.append(part[at : end[at]])
            at = after[at]
        return self._named(merged)

    def _named(self, merged: list[str]) -> tuple[list[int], list[int]]:
        ids: list[int] = []
        sizes: list[int] = []
        for piece in merged:
            hit = self.rank.get(piece)
            if hit:
                ids.append(hit[1])
                sizes.append(len(piece))
            elif self.byte_ids:
                raw = piece.encode("utf-8", "surrogatepass")
                ids += [self.byte_ids[b] for b in raw]
                sizes += [0] * (len(raw) - 1) + [len(piece)]
            else:
                ids.append(self.unknown)
                sizes.append(len(piece))
        return ids, sizes

    # Decoding ---------------------------------------------------------------------------------------------------

    def _surface(self, i: int) -> bytes:
        if self.kinds[i] == _CONTROL:
            return b""
        if self.kinds[i] == _BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        return (self.unknown_surface if self.kinds[i] == _UNKNOWN else self.pieces[i].replace(BLANK, " ")).encode()

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids: bytes that are no UTF-8 become U+FFFD each, and the blank that encoding puts before a text goes."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        made = list(map(self._bytes.__getitem__, ids))
        if self.dummy_prefix or self.squeeze:
            for k, i in enumerate(ids):
                if self.kinds[i] == _NORMAL and self.pieces[i].startswith(BLANK):
                    made[k] = made[k][1:]
                    if not (made[k] or self.dummy_prefix and not self.squeeze):
                        continue
                if self.kinds[i] != _CONTROL:
                    break
        if made.count(b"") <= (made[:1] == [b""]):  # nothing without a surface stands between bytes of one character
            try:
                return b"".join(made).decode()
            except UnicodeDecodeError:
                pass
        out, run = [], b""
        for i, b in zip(ids, made):
            if self.kinds[i] == _BYTE:
                run += b
                continue
            out += [_one_by_one(run), b.decode()]
            run = b""
        return "".join([*out, _one_by_one(run)])


def _one_by_one(run: bytes) -> str:
    """Bytes as UTF-8, each byte that belongs to no character as U+FFFD."""
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=4)
def model(path: str) -> PieceModel:
    """One per file and worker process."""
    with open(path, "rb") as f:
        return PieceModel(f.read())


def default_path() -> str:
    """The model that comes with the installed tokenizer files; every executor has it at this place."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, ids, starts, ends``: the pieces of every whole text, and the span of original bytes of each.

    Null and empty texts have no pieces; a text of blanks has those of its blanks, if the model keeps blanks.  Rows may repeat, ids may be null;
    other columns are not read, whatever their names.  Of a character that has no piece, the pieces of its bytes but the last have empty spans;
    of a replacement that is cut, the pieces but the last have.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0)
            for a, b in runs(sizes.to_pylist(), _ROOM):
                *values, count = m.encode_all(batch.column(1).slice(a, b - a).to_pylist())
                ends = pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32())
                columns = [batch.column(0).slice(a, b - a), sizes.slice(a, b - a).cast(pa.int64()), *(pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for v in values)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "ids", "starts", "ends"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_bytes long, ids array<int>, starts array<int>, ends array<int>")


def decode_ids(encoded: DataFrame, ids_col: str = "ids", into: str = "decoded", path: str | None = None) -> DataFrame:
    """Adds ``into``, the text of each row's ids; a column of that name is replaced.  Null ids are the empty text.  An id that the model does not have is an error."""
    path = path or default_path()
    rest = encoded.drop(into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            for a, b in runs([4 * (n or 0) for n in pa.compute.list_value_length(lists).to_pylist()], _ROOM):
                made = []
                for row in lists.slice(a, b - a):
                    made.append(m.decode(row.values.to_numpy(zero_copy_only=False)) if row.is_valid else "")
                cut = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*cut.columns, pa.array(made, pa.string())], [*cut.schema.names, into])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return rest.mapInArrow(run, f"{kinds}, `{into}` string")


def covered(n_bytes: Column, starts: Column, ends: Column) -> Column:
    """Whether the spans follow each other from the first byte to the last, without a gap."""
    meet = F.forall(F.zip_with(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))), lambda s, e: s == e), lambda x: x)
    return F.when(F.size(starts) == 0, n_bytes == 0).otherwise((F.element_at(starts, 1) == 0) & (F.element_at(ends, -1) == n_bytes) & meet)


def digests(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, covered`` of encoded texts, decoded from their ids."""
    facts = encoded.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        covered(F.col("n_bytes"), F.col("starts"), F.col("ends")).alias("covered"),
    )
    read = decode_ids(facts, path=path)
    return read.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "covered")
