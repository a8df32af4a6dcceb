"""Byte-level BPE of track names by batched numpy merge rounds, and the way back."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm.words import pieces, slices, texts
from encore.session import ship_package

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Pieces whose ids a worker keeps.
CACHE = 200_000
#: Fixed value: the public pattern that cuts a text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Below this code point the character classes of ``regex`` and of the tokenizer library are the same whatever their Unicode versions.
STABLE = "\u0250"
#: Pieces of printable characters and single inner line feeds; joined by single spaces they are cut in one go.
_PRINTED = re.compile("[!-~\u00a1-\u00ac\u00ae-\u024f]+(?:\n[!-~\u00a1-\u00ac\u00ae-\u024f]+)*")
ROWS = 512
SHIFT = 20
NEVER = np.int64(2**62)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it can be printed, else one from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    letters, spare = [], 256
    for byte in range(256):
        letters.append(chr(byte if byte in shown else spare))
        spare += byte not in shown
    return letters


class Ragged:
    """Rows of different lengths in one flat array; row i ends before ``ends[i + 1]``."""

    def __init__(self, flat: np.ndarray, ends: np.ndarray):
        self.flat, self.ends = flat, ends

    def __len__(self) -> int:
        return len(self.ends) - 1

    def take(self, rows: np.ndarray) -> Ragged:
        sizes = np.diff(self.ends)[rows]
        ends = np.append(0, np.cumsum(sizes))
        return Ragged(self.flat[np.arange(ends[-1]) + np.repeat(self.ends[rows] - ends[:-1], sizes)], ends)

    def joined(self, starts: np.ndarray) -> Ragged:
        """Neighbouring rows joined; ``starts`` are the first rows of the new ones, and the number of rows."""
        return Ragged(self.flat, self.ends[starts])

    def and_then(self, more: Ragged) -> Ragged:
        return Ragged(np.concatenate((self.flat, more.flat)), np.concatenate((self.ends, more.ends[1:] + self.ends[-1])))


def ragged(rows: list, kind: type) -> Ragged:
    ends = np.append(0, np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows))))
    return Ragged(np.fromiter(chain.from_iterable(rows), kind, ends[-1]), ends)


NO_ROWS = Ragged(np.empty(0, np.int32), np.zeros(1, np.int64))


class Bpe:
    """Merge tables of one tokenizer file and a cache of encoded pieces."""

    current: tuple[str, Bpe] | None = None

    def __init__(self, model: str):
        from tokenizers.pre_tokenizers import ByteLevel

        spec = json.loads(model)
        bpe, cut = spec["model"], spec["pre_tokenizer"]
        plain = bpe["type"] == "BPE" and cut["type"] == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and not spec["normalizer"]
        if not plain or bpe.get("ignore_merges") or any(a[k] for a in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("only byte-level BPE with the public pattern, no normaliser and plain added tokens is supported")
        ids, letters = bpe["vocab"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.first = np.array([ids[c] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in bpe["merges"]]
        keys = np.array([ids[a] << SHIFT | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)[order]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        tokens = [b""] * (1 + max(*ids.values(), *self.special.values()))
        for token, i in ids.items():
            tokens[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            tokens[i] = token.encode()
        self.bytes = ragged(tokens, np.uint8)
        self.pattern = regex.compile(PATTERN)
        self.cutter = ByteLevel(add_prefix_space=False, use_regex=True)
        longest = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.marks = regex.compile(f"({'|'.join(longest)})") if longest else None
        self.known: dict[str | tuple[str], int] = {}
        self.store = NO_ROWS

    @classmethod
    def of(cls, key: str, model: str) -> Bpe:
        """The instance of this worker, made once per model."""
        if cls.current is None or cls.current[0] != key:
            cls.current = (key, cls(model))
        return cls.current[1]

    def merge(self, words: list[bytes]) -> Ragged:
        """Ids of non-empty pre-tokens.

        All symbols lie in one flat array, with the rank of the pair that each
        begins, found by binary search over the sorted pair keys. A round merges, in
        each word, all places of its pair of lowest rank, from the left; that equals
        merging one place at a time, since a new symbol only takes part in later
        ranks. Then the pairs next to new symbols are looked up again. Words
        without a pair leave the array.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        place, rank = np.zeros(len(symbols), np.int64), np.full(len(symbols), NEVER)

        def look_up(at: np.ndarray) -> None:
            rank[at] = NEVER
            at = at[at + 1 < len(symbols)]
            at = at[owner[at] == owner[at + 1]]
            key = (symbols[at] << SHIFT) | symbols[at + 1]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            place[at] = found
            rank[at] = np.where(self.keys[found] == key, self.ranks[found], NEVER)

        look_up(np.arange(len(symbols)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(symbols))))
            ended = lowest == NEVER
            if ended.any():
                done.append((owner[ended], symbols[ended]))
            at = np.flatnonzero((rank == lowest) & ~ended)
            if len(at):
                # of overlapping places (a run such as "aaa") every second one counts, from the left
                opens = np.append(True, np.diff(at) > 1)
                run = np.flatnonzero(opens)[np.cumsum(opens) - 1]
                at = at[(np.arange(len(at)) - run) % 2 == 0]
                symbols[at] = self.merged[place[at]]
            keep = ~ended
            keep[at + 1] = False
            new = (np.cumsum(keep) - 1)[at]
            symbols, owner, place, rank = symbols[keep], owner[keep], place[keep], rank[keep]
            look_up(np.concatenate((new, new[new > 0] - 1)))
        if not done:
            return NO_ROWS
        owners = np.concatenate([o for o, _ in done])
        flat = np.concatenate([x for _, x in done])[np.argsort(owners, kind="stable")].astype(np.int32)
        return Ragged(flat, np.append(0, np.cumsum(np.bincount(owners, minlength=len(words)))))

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text without added tokens."""
        if max(text) < STABLE:
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(text)]

    def _tokens(self, text: str) -> list[str | int]:
        """Pre-tokens of a whole string, and ids of the added tokens in it."""
        out: list[str | int] = []
        for bit in self.marks.split(text) if self.marks and self.marks.search(text) else (text,):
            if bit in self.special:
                out.append(self.special[bit])
            elif bit:
                out.extend(self.words(bit))
        return out

    def _merged(self, tokens: list[str]) -> Ragged:
        """Ids of pre-tokens, each distinct one merged once."""
        places = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
        return self.merge([t.encode() for t in places]).take(np.fromiter(map(places.__getitem__, tokens), np.int64, len(tokens)))

    def learn(self, new: list[str], heads: list[str]) -> None:
        """Add pieces (which follow a space) and heads of texts (which do not) to the cache."""
        marked = self.marks is not None and self.marks.search(" ".join(new)) is not None
        plain = [w for w in new if _PRINTED.fullmatch(w) and not (marked and self.marks.search(w))]
        if plain:
            # no piece holds a space, so a pre-token that starts with one begins the next piece
            tokens = self.pattern.findall(" " + " ".join(plain))
            opens = np.fromiter((t[0] == " " for t in tokens), bool, len(tokens))
            self._keep(plain, self._merged(tokens).joined(np.append(np.flatnonzero(opens), len(tokens))))
        easy = set(plain)
        odd: list[str | tuple[str]] = [w for w in new if w not in easy]
        odd += [(h,) for h in heads]
        cut = [self._tokens(w[0] if isinstance(w, tuple) else " " + w) for w in odd]
        ids = self._merged([t for row in cut for t in row if isinstance(t, str)])
        at = iter(range(len(ids)))
        rows = [list(chain.from_iterable((t,) if isinstance(t, int) else ids.flat[slice(*ids.ends[(i := next(at)) : i + 2])].tolist() for t in row)) for row in cut]
        self._keep(odd, ragged(rows, np.int32))

    def _keep(self, keys: list, rows: Ragged) -> None:
        self.known.update(zip(keys, range(len(self.store), len(self.store) + len(keys))))
        self.store = self.store.and_then(rows)

    def encode(self, names: list[str]) -> Ragged:
        """Ids of whole texts; pieces seen before come from the cache."""
        cut: list[list] = [pieces(text) for text in names]
        if len(self.known) > CACHE:
            self.known, self.store = {}, NO_ROWS
        heads = list({row[0] for row in cut})
        for row in cut:
            row[0] = (row[0],)
        new = set(chain.from_iterable(row[1:] for row in cut)).difference(self.known)
        self.learn(list(new), [h for h in heads if (h,) not in self.known])
        starts = np.append(0, np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut))))
        places = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, starts[-1])
        return self.store.take(places).joined(starts)

    def decode(self, ids: Ragged) -> list[str]:
        rows = self.bytes.take(ids.flat).joined(ids.ends)
        data, ends = rows.flat.tobytes(), rows.ends.tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


def _sent(tracks: DataFrame, tokenizer: str):
    spark = tracks.sparkSession
    ship_package(spark)
    with open(tokenizer, encoding="utf-8") as source:
        return spark.sparkContext.broadcast((os.urandom(8).hex(), source.read()))


def encode_names(
    tracks: DataFrame, track_id: str = "track_id", track_name: str = "track_name", tokenizer: str = TOKENIZER, decoded: str | None = None
) -> DataFrame:
    """Token ids of every whole track name, as the library encodes it without adding special tokens.

    The tokenizer file is broadcast (a fixed file of some MB). Tasks encode the
    pieces that their worker has not seen in batched merge rounds; there is no
    shuffle. A null name is empty and has no ids; ids of tracks may be null or
    repeat, each row gives one row. An empty table gives no rows; other columns
    are ignored.

    With ``decoded`` the same task decodes the ids it made, as ``decode_names``
    does, into a column of that name: one Python worker per task instead of two.

    Columns: track_id, token_ids array<int>, and the decoded text where asked for.
    """
    sent = _sent(tracks, tokenizer)
    names = ["id", "token_ids", *([decoded] if decoded else [])]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.of(*sent.value)
        for part in slices(batches, ROWS):
            rows = bpe.encode(texts(part.column(1)))
            ids = pa.ListArray.from_arrays(pa.array(rows.ends, pa.int32()), pa.array(rows.flat, pa.int32()))
            back = [pa.array(bpe.decode(rows), pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([part.column(0), ids, *back], names)

    rows = tracks.select(F.col(track_id).alias("id"), F.col(track_name).alias("name"))
    kind = rows.schema["id"].dataType.simpleString()
    shape = f"id {kind}, token_ids array<int>" + (f", `{decoded}` string" if decoded else "")
    return rows.mapInArrow(encode, shape).withColumnRenamed("id", track_id)


def decode_names(encoded: DataFrame, track_id: str = "track_id", tokenizer: str = TOKENIZER) -> DataFrame:
    """Track names from ``token_ids``; special tokens stay, bytes that are no UTF-8 become replacement characters.

    Null ids decode to an empty name. Columns: track_id, token_ids, track_name.
    """
    sent = _sent(encoded, tokenizer)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.of(*sent.value)
        for part in slices(batches):
            lists = part.column(1).fill_null([])
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            names = bpe.decode(Ragged(lists.flatten().to_numpy(), np.append(0, np.cumsum(sizes, dtype=np.int64))))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string())], ["id", "token_ids", "track_name"])

    rows = encoded.select(F.col(track_id).alias("id"), "token_ids")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(decode, f"id {kind}, token_ids array<int>, track_name string").withColumnRenamed("id", track_id)
