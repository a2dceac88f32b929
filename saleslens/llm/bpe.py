"""Byte-pair encoding by backtracking over longest token matches, and decoding by an offset table.

A piece of text is read left to right. One Aho-Corasick pass finds the longest token that starts at
each place. A token is taken if the pair with the token before it is compatible: merging the two
side by side would leave both as they are. If not, the longest shorter token at the place is tried,
and if there is none the token before is given up. Places that were given up are marked, so each is
left once and the work grows linearly with the piece. The tokens found this way are those of the
merges, applied in order of rank.

Pieces repeat, so each Python worker keeps the tokens of the pieces it met, in two generations of
bounded size. The tokenizer file is read by the driver and sent as text; its size is the file's.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from saleslens.llm.common import add_fields, appended, fresh, map_rows

#: Blocks of letters, marks and signs that Unicode has long filled. Texts within them are normalised
#: and split here; libraries differ on code points that were assigned later, so texts with others
#: leave these two steps to the tokenizer library.
SETTLED = ((0x0, 0x557), (0x2000, 0x2064), (0x20A0, 0x20BD), (0x3000, 0x303F), (0x3041, 0x3096),
           (0x30A1, 0x30FE), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
_UNSETTLED = re.compile("[^" + "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in SETTLED) + "]")
CACHE_PIECES = 150_000
CACHED_CHARS = 64
_BUILT: dict[str, Tokenizer] = {}


def _ranges(kind: str) -> str:
    """The settled code points of a general category (``Z``: white space) as ranges of a pattern."""
    spaces = {*range(9, 14), 32, 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
    out, begin = [], None
    for low, high in SETTLED:
        for c in range(low, high + 2):
            inside = c <= high and (c in spaces if kind == "Z" else unicodedata.category(chr(c))[0] == kind)
            if inside and begin is None:
                begin = c
            elif not inside and begin is not None:
                out.append(rf"\U{begin:08x}-\U{c - 1:08x}")
                begin = None
    return "".join(out)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else the next free one from 256."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(free)) for b in range(256)]


class Tokenizer:
    """A byte-level BPE with a word-end mark, from the JSON text of a ``tokenizers`` file.

    Read from the file: special tokens, merges, vocabulary, split pattern, word-end mark. A file
    with other normalising, splitting or decoding steps than lower-casing NFC text, the split and
    the byte letters is refused.
    """

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [s["type"] for s in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        split = spec["pre_tokenizer"]["pretokenizers"][0] if splits else {}
        if (steps != ["NFC", "Replace", "Lowercase"] or splits != ["Split", "ByteLevel"] or spec["decoder"] is not None
                or not split["invert"] or split["behavior"] != "Removed" or model["type"] != "BPE"
                or not model["end_of_word_suffix"] or model["continuing_subword_prefix"] or model["ignore_merges"]):
            raise ValueError("not a lower-casing byte-level BPE with a word-end mark")
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("special tokens with stripping or normalising are not supported")
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        pattern = split["pattern"]["Regex"]
        own = pattern.replace(r"\p{L}", _ranges("L")).replace(r"\p{N}", _ranges("N")).replace(r"\s", _ranges("Z"))
        self._pieces = re.compile(own)
        self._normalize = tokenizers.Tokenizer.from_str(source).normalizer.normalize_str
        self._split = tokenizers.pre_tokenizers.Split(tokenizers.Regex(pattern), "removed", invert=True).pre_tokenize_str
        self._load(model)
        self._young: dict[str, list[int]] = {}
        self._old: dict[str, list[int]] = {}

    # -- tables --------------------------------------------------------------------------------

    def _load(self, model: dict) -> None:
        """Tokens as strings over 512 symbols: a byte, or 256 + a byte that ends its word."""
        byte_of = {letter: b for b, letter in enumerate(_byte_letters())}
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]

        def symbols(token: str) -> str | None:
            body, ends = (token[: -len(suffix)], True) if token.endswith(suffix) and token != suffix else (token, False)
            if any(c not in byte_of for c in body):
                return None
            out = [byte_of[c] for c in body]
            return "".join(map(chr, [*out[:-1], out[-1] + 256 * ends]))

        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: the rank of the merge that makes a token; -1 for a symbol
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        texts: dict[str, int] = {}
        for token, number in vocab.items():
            if (s := symbols(token)) is not None and len(s) == 1:
                texts[s], self.rank[number] = number, -1
        for at, (a, b) in enumerate(merges):
            made = vocab[a + b]
            self.merge[vocab[a], vocab[b]] = at
            if made not in self.rank:
                self.rank[made], self.parts[made] = at, (vocab[a], vocab[b])
                texts[symbols(a + b)] = made
        self._fits: dict[tuple[int, int], bool] = {}
        # A token that its own merges would not make never comes out of them.
        texts = {s: t for s, t in texts.items() if t not in self.parts or self._compatible_parts(t)}
        self.length = {t: len(s) for s, t in texts.items()}
        self.shorter: dict[int, int | None] = {}
        for s, t in texts.items():
            self.shorter[t] = next((texts[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in texts), None)
        self._matches = ahocorasick.Automaton()
        for s, t in texts.items():
            self._matches.add_word(s, (len(s), t))
        self._matches.make_automaton()
        # the offset table of decoding
        names = {**{n: t for t, n in vocab.items()}, **{n: t for t, n in self.specials.items()}}
        size = max(names) + 1
        tokens = [names.get(i, "").encode() for i in range(size)]
        self.offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in tokens])))
        self.blob = np.frombuffer(b"".join(t + b" " for t in tokens), np.uint8)
        self.known = np.array([i in names for i in range(size)])
        self.decimal = [str(i) for i in range(size)]

    def _compatible_parts(self, token: int) -> bool:
        """Whether a token's two parts stay apart under all merges before its own."""
        left, right = self.parts[token]
        return self._apart(left, right, self.rank[token])

    def _apart(self, left: int, right: int, before: int) -> bool:
        """Whether no merge of a rank under ``before`` joins the two tokens across their border.

        Both are undone from the later merge back to the earlier. At each step the two pieces at
        the border stand side by side from the moment the later of them is made until it is itself
        merged on; a merge that joins them and comes within that time would have been applied.
        """
        merge, rank, parts = self.merge, self.rank, self.parts
        while True:
            # Merges of equal rank run left to right: one at the border beats a later one inside
            # the right token, and the left token's own merge of that rank comes first.
            join = merge.get((left, right))
            if join is not None and join < before:
                return False
            if rank[left] < 0 and rank[right] < 0:
                return True
            if rank[left] >= rank[right]:
                before = min(before, rank[left])
                left = parts[left][1]
            else:
                before = min(before, rank[right] + 1)
                right = parts[right][0]

    def compatible(self, left: int, right: int) -> bool:
        """The pair table: filled as pairs are met, emptied when it is large."""
        found = self._fits.get((left, right))
        if found is None:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            found = self._fits[left, right] = self._apart(left, right, len(self.merge))
        return found

    # -- encoding ------------------------------------------------------------------------------

    def _encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode()
        line = raw[:-1].decode("latin-1") + chr(256 + raw[-1])
        n = len(line)
        longest: list = [None] * n
        best = [0] * n
        for end, (length, token) in self._matches.iter(line):
            start = end - length + 1
            if length > best[start]:
                best[start], longest[start] = length, token
        out: list[int] = []
        open_, at, token = bytearray(b"\1" * (n + 1)), 0, longest[0]
        length, shorter = self.length, self.shorter
        while at < n:
            end = at + length[token]
            if open_[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else None
                continue
            token = shorter[token]
            while token is None:
                open_[at] = 0
                token = out.pop()
                at -= length[token]
                token = shorter[token]
        return out

    def _piece(self, piece: str) -> list[int]:
        found = self._young.get(piece)
        if found is None:
            found = self._old.get(piece) or self._encode_piece(piece)
            if len(piece) <= CACHED_CHARS:
                if len(self._young) >= CACHE_PIECES:
                    self._old, self._young = self._young, {}
                self._young[piece] = found
        return found

    def encode(self, text: str) -> list[int]:
        """The token numbers of a whole text."""
        out: list[int] = []
        get, piece = self._young.get, self._piece
        for k, part in enumerate(self._special.split(text) if "<" in text and self._special.search(text) else [text]):
            if k % 2:
                out.append(self.specials[part])
                continue
            # lower-cased letter by letter, so a final sigma gets no form of its own
            plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            if _UNSETTLED.search(part) or _UNSETTLED.search(plain):
                pieces = [p for p, _ in self._split(self._normalize(part))]
            else:
                pieces = self._pieces.findall(plain)
            for p in pieces:
                found = get(p)
                if found is None:
                    found = piece(p)
                    get = self._young.get
                out += found
        return out

    # -- decoding ------------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> bytes:
        """The tokens' texts joined by blanks, in UTF-8: copied out of one table by offsets."""
        numbers = np.asarray(ids, np.int64)
        numbers = numbers[(numbers >= 0) & (numbers < len(self.known))]
        numbers = numbers[self.known[numbers]]
        out = []
        for k in range(0, len(numbers), 1 << 16):
            part = numbers[k : k + (1 << 16)]
            starts = self.offsets[part]
            sizes = self.offsets[part + 1] - starts
            ends = np.cumsum(sizes)
            out.append(self.blob[np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)].tobytes())
        return b"".join(out)[:-1]


def _tokenizer(key: str, source) -> Tokenizer:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Tokenizer(source.value)
    return _BUILT[key]


def _shared(spark, path: str):
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read()), uuid.uuid4().hex


def encode(docs: DataFrame, path: str, text: str = "text", wanted=("n_tokens", "ids", "ids_sha256", "decoded_sha256")
           ) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its texts encoded and decoded again, and the names of the added columns.

    Added are those ``wanted`` of ``n_tokens``, ``ids``, ``ids_sha256`` (of the decimal ids joined by
    one blank), ``decoded`` and ``decoded_sha256``. Names that ``docs`` has already get a ``_``. A
    null text counts as empty: no ids, and the empty text decoded. Every text is taken whole; a
    special token's string in a text is that token.
    """
    names = dict(zip(wanted, fresh(docs.columns, *wanted), strict=True))
    types = {"n_tokens": (T.LongType(), pa.int64()), "ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
             "ids_sha256": (T.StringType(), pa.string()), "decoded": (T.StringType(), pa.string()),
             "decoded_sha256": (T.StringType(), pa.string())}
    source, key = _shared(docs.sparkSession, path)
    at = docs.columns.index(text)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokenizer = _tokenizer(key, source)
        out: dict[str, list] = {w: [] for w in wanted}
        for value in batch.column(at):
            ids = tokenizer.encode(value.as_py() or "")
            if "n_tokens" in out:
                out["n_tokens"].append(len(ids))
            if "ids" in out:
                out["ids"].append(ids)
            if "ids_sha256" in out:
                line = " ".join([tokenizer.decimal[i] for i in ids])
                out["ids_sha256"].append(hashlib.sha256(line.encode()).hexdigest())
            if "decoded" in out or "decoded_sha256" in out:
                plain = tokenizer.decode(ids)
                if "decoded" in out:
                    out["decoded"].append(plain.decode())
                if "decoded_sha256" in out:
                    out["decoded_sha256"].append(hashlib.sha256(plain).hexdigest())
        return appended(batch, *((names[w], pa.array(out[w], types[w][1])) for w in wanted))

    return map_rows(docs, add_fields(docs.schema, *((names[w], types[w][0]) for w in wanted)), fn), names


def decode(rows: DataFrame, path: str, ids: str = "ids") -> tuple[DataFrame, str]:
    """``rows`` with the text of an array column of token numbers, and that column's name.

    Null ids decode to null, unknown numbers to nothing.
    """
    (name,) = fresh(rows.columns, "decoded")
    source, key = _shared(rows.sparkSession, path)
    at = rows.columns.index(ids)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokenizer = _tokenizer(key, source)
        texts = [None if v is None else tokenizer.decode([x for x in v if x is not None]).decode()
                 for v in batch.column(at).to_pylist()]
        return appended(batch, (name, pa.array(texts, pa.string())))

    return map_rows(rows, add_fields(rows.schema, (name, T.StringType())), fn), name
