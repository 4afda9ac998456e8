"""Whole texts to token ids with the tokenizers library, through a cache of word pieces."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATOR = "\x0b"
#: A space between two non-spaces always starts a new word of the byte-level pattern, so the
#: text may be cut there; U+180E counts as a space in some Unicode versions.
_CUT = re.compile(r" (?<=[^\s᠎] )(?=[^\s᠎])")
#: Words of the byte-level pattern within a piece, for the plainest characters: letters, digits, marks but the apostrophe
#: (it begins contractions), a single line break. Runs of letters, digits and marks always end where the next kind begins.
_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+|\n")
LINE = "\n"
#: The marks of that pattern, and those of them that begin no contraction.
MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'")
#: Bytes of an id in the streams.
WIDTH = 4


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes texts like ``encode_batch(texts, add_special_tokens=False)`` of the library.

    Special-token strings in a text count as ordinary text. The pieces between cuts are
    encoded once and kept, in two generations of together ``cache_pieces`` pieces (and those of one call) of at most
    ``piece_chars`` characters: when the younger is full it becomes the older, whose pieces go unless they are used again.
    """

    def __init__(self, path: str, cache_pieces: int = 1_000_000, piece_chars: int = 48):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        #: Ids of " " + piece.
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cache_pieces, self.piece_chars = cache_pieces, piece_chars
        #: Ids of words within pieces, without a space.
        self.later: dict[str, bytes] = {LINE: self._alone([LINE])[0]}
        mark = self._ids([SEPARATOR])[0]
        self.mark = mark[0] if len(mark) == 1 else None

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(ids, "<u4").tobytes() for ids in self._ids(texts)]

    def _many(self, pieces: list[str], lead: str) -> dict[str, bytes]:
        """Ids of lead + piece, many pieces in one call, apart by a separator.

        The pieces neither begin nor end with white space, so the separator stays one token.
        """
        found: dict[str, bytes] = {}
        for i in range(0, len(pieces), 2000):
            group = pieces[i : i + 2000]
            joined = lead + f"{SEPARATOR}{lead}".join(group)
            if self.mark is None or joined.count(SEPARATOR) != len(group) - 1:
                found.update(zip(group, self._alone([lead + p for p in group]), strict=True))
                continue
            flat = np.asarray(self._ids([joined])[0], "<u4")
            cuts = np.flatnonzero(flat == self.mark) * WIDTH
            if len(cuts) != len(group) - 1:
                raise ValueError("a separator merged with its neighbours")
            raw = flat.tobytes()
            found.update(zip(group, [raw[a:b] for a, b in zip([0, *(cuts + WIDTH).tolist()], [*cuts.tolist(), len(raw)], strict=True)], strict=True))
        return found

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of " " + piece, of distinct pieces. A short piece of several words of the pattern is put together from theirs, which recur more often."""
        apart: dict[str, list[str]] = {}
        whole = []
        for p in pieces:
            if p.isalpha() or len(p) > self.piece_chars:
                whole.append(p)
                continue
            word = p.rstrip(MARKS)
            if word.isascii() and word.isalpha():
                apart[p] = [word, p[len(word) :]]
                continue
            words = _WORD.findall(p)
            if len(words) > 1 and sum(map(len, words)) == len(p) and "\n\n" not in p:
                apart[p] = words
            else:
                whole.append(p)
        first = {words[0] for words in apart.values()}.difference(self.cache, whole)
        found = self._many([*whole, *first], " ")
        new = {w for words in apart.values() for w in words[1:]}.difference(self.later)
        if len(self.later) + len(new) > self.cache_pieces:
            new = {w for words in apart.values() for w in words[1:]} - {LINE}
            self.later = {LINE: self.later[LINE]}
        self.later.update(self._many(list(new), ""))
        later = self.later.__getitem__
        for p, words in apart.items():
            lead = found.get(words[0])
            found[p] = b"".join((self.cache[words[0]] if lead is None else lead, *map(later, words[1:])))
        # as the cache is met, words that began a piece are kept too
        for p in first:
            self.cache[p] = found[p]
        return [*map(found.__getitem__, pieces)]

    def _lookup(self, pieces: list[str], held: list[bytes | None]) -> list[bytes]:
        """Ids of " " + piece, of distinct pieces between cuts; ``held``: what the cache has of them."""
        missed = [k for k, ids in enumerate(held) if ids is None]
        new = []
        for k in missed:
            p = pieces[k]
            ids = held[k] = self.older.get(p)
            if ids is None:
                new.append(k)
            else:
                self.cache[p] = ids
        for k, ids in zip(new, self._learn([pieces[k] for k in new]), strict=True):
            held[k] = ids
            if len(pieces[k]) <= self.piece_chars:
                self.cache[pieces[k]] = ids
        return held

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        Plain splitting at spaces gives the pieces of texts without a piece that is empty, has white space at an end or holds
        U+180E; Arrow numbers these pieces, so a piece is looked up once for all texts and its ids are laid out by number.
        """
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        numbered = lists.values.dictionary_encode()
        number, bounds = numbered.indices.to_numpy(), lists.offsets.to_numpy()
        words = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        if 2 * len(self.cache) > self.cache_pieces:
            self.older, self.cache = self.cache, {}
        kept = [*map(self.cache.get, words)]
        # what is kept was between cuts, so it is none of those
        odd = [k for k, ids in enumerate(kept) if ids is None and ((p := words[k]).strip() != p or not p or "\u180e" in p)]
        is_odd = np.zeros(len(words), bool)
        is_odd[odd] = True
        apart = {i: _CUT.split(texts[i]) for i in set((np.searchsorted(bounds, np.flatnonzero(is_odd[number]), "right") - 1).tolist())}
        heads = self._alone([apart[i][0] if i in apart else words[number[bounds[i]]] for i in range(len(texts))])
        # the last piece of a text may have white space at its end
        tails = [i for i in apart if len(apart[i]) > 1 and (texts[i][-1].isspace() or texts[i][-1] == "\u180e")]
        ends = dict(zip(tails, self._alone([" " + apart[i].pop() for i in tails]), strict=True))
        # the first piece has no space before it
        later = np.ones(len(number), bool)
        later[bounds[:-1]] = False
        for i in apart:
            later[bounds[i] : bounds[i + 1]] = False
        is_asked = np.zeros(len(words), bool)
        is_asked[number[later]] = True
        asked = np.flatnonzero(is_asked).tolist()
        held = self._lookup([words[k] for k in asked], [kept[k] for k in asked])
        more = list(set().union(*(cut[1:] for cut in apart.values())))
        known = dict(zip(more, self._lookup(more, [*map(self.cache.get, more)]), strict=True))
        size = np.zeros(len(words), np.int64)
        size[asked] = np.fromiter(map(len, held), np.int64, len(asked)) // WIDTH
        place = np.cumsum(size) - size
        sizes = np.where(later, size[number], 0)
        after = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(place[number] - after[:-1], sizes)
        at += np.arange(len(at))
        raw = np.frombuffer(b"".join(held), "<u4")[at].tobytes()
        ids = (after[bounds] * WIDTH).tolist()
        out = []
        for i, head in enumerate(heads):
            if i in apart:
                out.append(b"".join((head, *(known[p] for p in apart[i][1:]), ends.get(i, b""))))
            else:
                out.append(head + raw[ids[i] : ids[i + 1]])
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_in_blocks(path: str, rows: list[tuple], text_at: int, chars: int = 4_000_000):
    """(row, ids as bytes) of rows, encoded together up to ``chars`` characters at a time."""
    block: list[tuple] = []
    size = 0
    for row in rows:
        block.append(row)
        size += len(row[text_at] or "")
        if size >= chars:
            yield from zip(block, encoder(path).encode([r[text_at] or "" for r in block]), strict=True)
            block, size = [], 0
    if block:
        yield from zip(block, encoder(path).encode([r[text_at] or "" for r in block]), strict=True)
