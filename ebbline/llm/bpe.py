"""BPE encoding and decoding by per-prefix dynamic programming.

In an encoding made by merges in rank order, the last token of every prefix of a word is
unique. It is found from left to right: of the vocabulary's tokens that end at this
position (the matches of a suffix automaton, longest first) it is the one that may follow
the last token of the prefix before it, and two tokens may stand side by side if merging
their concatenation gives back the same two. Following the stored last tokens back from
the word's end gives the exact ids.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.llm.common import map_arrow, slices, worker_keeps

#: White space of Unicode, which separates words here; str.split() also cuts at 1C to 1F.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
#: The file's pattern for ASCII text without apostrophes.
_ASCII_WORD = re.compile("[a-z]+|[0-9]|[^a-z0-9]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    shown = set(plain)
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class PrefixBPE:
    """Encoder and decoder for a byte-level BPE file with word ends (``</w>``).

    Ids are those of the file; truncation and padding are unused and no special tokens
    are added, but their strings in a text become their ids, as the library has it.
    """

    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        byte_of = {c: chr(b) for b, c in enumerate(byte_alphabet())}

        def symbols(token: str) -> str:
            # one character per byte; the last byte of a word is a symbol of its own
            last = token.endswith(end)
            s = "".join(byte_of[c] for c in (token[: -len(end)] if last else token))
            return s[:-1] + chr(256 + ord(s[-1])) if last else s

        self.text_of = {i: t for t, i in vocab.items()}
        spelled = {t: symbols(t) for t in vocab}
        rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int]] = {}
        for k, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            rank[pair] = k
            made.setdefault(whole, pair)
        self.rank = rank
        #: Rank at which a token comes about; a symbol has none (-1).
        self.born = {i: rank[made[i]] if i in made else -1 for i in self.text_of}
        self.parts = made
        self.single = {s: vocab[t] for t, s in spelled.items() if len(s) == 1}
        matches = ahocorasick.Automaton()
        for t, s in spelled.items():
            matches.add_word(s, (vocab[t], len(s)))
        matches.make_automaton()
        self.automaton = matches
        self.fits: dict[tuple[int, int], bool] = {}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split["pattern"]["Regex"])
        # beyond Latin the library's own character tables cut the words
        library = Tokenizer.from_file(path)
        self.normalise = library.normalizer.normalize_str
        self.cut = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), split["behavior"].lower(), split["invert"]).pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.text_of |= {i: t for t, i in self.special.items()}
        self.mark = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    # -- words -----------------------------------------------------------------
    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the concatenation of two tokens gives back just these two.

        Undo the merges that made the two sides, latest first; a merge across the border
        that ranks before the one undone last would have happened first.
        """
        key = left << 20 | right
        seen = self.fits.get(key)
        if seen is not None:
            return seen
        born, parts, rank = self.born, self.parts, self.rank
        a, b, ok = left, right, True
        before, from_right = 1 << 62, False  # a crossing merge has to come before this to spoil the pair
        while True:
            r = rank.get((a, b))
            # of equal merges the left one goes first, so it also spoils what was undone on the right
            if r is not None and (r < before or (r == before and from_right)):
                ok = False
                break
            ra, rb = born[a], born[b]
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                before, from_right, a = ra, False, parts[a][1]
            else:
                before, from_right, b = rb, True, parts[b][0]
        if len(self.fits) > 500_000:
            self.fits.clear()
        self.fits[key] = ok
        return ok

    def word_ids(self, symbols: str) -> list[int]:
        """Ids of one word, given as byte symbols with the last one marked."""
        n = len(symbols)
        last, size = [-1] * (n + 1), [0] * (n + 1)  # the last token of each prefix, and its length
        known, fits = self.fits.get, self.compatible
        for end, (token, length) in self.automaton.iter(symbols):  # at each end, longest first
            end += 1
            if size[end]:
                continue
            start = end - length
            if start:
                left = last[start]
                if left < 0:
                    continue
                ok = known(left << 20 | token)
                if ok is None:
                    ok = fits(left, token)
                if not ok:
                    continue
            last[end], size[end] = token, length
        out = []
        while n > 0:
            out.append(last[n])
            n -= size[n]
        out.reverse()
        return out

    # -- chunks: runs without white space ----------------------------------------
    def chunk_words(self, chunk: str) -> list[str]:
        """Words of a chunk that holds no special token, normalised."""
        if chunk.isascii():
            chunk = chunk.lower()
            if "'" not in chunk:
                return [chunk] if chunk.isalpha() else _ASCII_WORD.findall(chunk)
        elif max(chunk) >= "\u0250":
            return [w for w, _ in self.cut(self.normalise(chunk))]
        else:
            chunk = "".join(map(str.lower, unicodedata.normalize("NFC", chunk)))
        return self.word.findall(chunk)

    def pieces(self, chunk: str):
        """(normalised word, None) or (text, id) for a special token, in order."""
        at = 0
        if self.mark and "<|" in chunk:
            for m in self.mark.finditer(chunk):
                for word in self.chunk_words(chunk[at : m.start()]):
                    yield word, None
                yield m[0], self.special[m[0]]
                at = m.end()
        for word in self.chunk_words(chunk[at:] if at else chunk):
            yield word, None

    def ids_of_word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "replace").decode("latin-1")
        return self.word_ids(raw[:-1] + chr(256 + ord(raw[-1])))

    def decode(self, ids) -> str:
        """The library's decoding for a file without decoder: tokens joined by spaces."""
        text = self.text_of
        return " ".join(text[i] for i in ids if i in text)


class ChunkCache(dict):
    """chunk -> (ids as little-endian uint32 bytes, decoded text).

    Chunks and their words are kept in two generations of ``limit`` entries at most, long
    ones not at all, so the memory is bounded whatever the corpus holds.
    """

    def __init__(self, bpe: PrefixBPE, limit: int = 200_000):
        super().__init__()
        self.bpe, self.limit, self.old, self.words = bpe, limit, {}, {}

    def word(self, word: str) -> tuple[bytes, str]:
        found = self.words.get(word)
        if found is None:
            ids = self.bpe.ids_of_word(word)
            found = (_packed(ids), self.bpe.decode(ids))
            if len(word) <= 64:
                if len(self.words) >= 2 * self.limit:
                    self.words.clear()
                self.words[word] = found
        return found

    def __missing__(self, chunk: str) -> tuple[bytes, str]:
        found = self.old.get(chunk)
        if found is None:
            got = [self.word(w) if i is None else (_packed([i]), w) for w, i in self.bpe.pieces(chunk)]
            found = got[0] if len(got) == 1 else (b"".join([x[0] for x in got]), " ".join([x[1] for x in got]))
        if len(chunk) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[chunk] = found
        return found


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def chunk_cache(path: str) -> ChunkCache:
    """One per Python worker."""
    return worker_keeps(("bpe", path), lambda: ChunkCache(PrefixBPE(path)))


def split_chunks(text: str) -> list[str]:
    """Chunks between Unicode white space; whole text, whatever its length."""
    if _NOT_SPACE.search(text):
        import regex

        return regex.findall(r"\S+", text)
    return text.split()


def encode_text(text: str | None, cache: ChunkCache) -> tuple[bytes, str]:
    """Packed ids and decoded text of a whole text."""
    found = [cache[c] for c in split_chunks(text or "")]
    if not found:
        return b"", ""
    ids, told = zip(*found, strict=True)
    return b"".join(ids), " ".join(told)


def _digests(path: str, full: bool):
    def run(batches):
        cache = chunk_cache(path)
        for batch in batches:
            for part in slices(batch, 500):
                ids_of, n, sha, sha_back, back = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    raw, told = encode_text(text, cache)
                    n.append(len(raw) // 4)
                    sha.append(hashlib.sha256(raw).hexdigest())
                    sha_back.append(hashlib.sha256(told.encode("utf-8", "replace")).hexdigest())
                    if full:
                        ids_of.append(np.frombuffer(raw, "<u4").astype(np.int32))
                        back.append(told)
                cols = [part.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(sha_back, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if full:
                    cols += [pa.array(ids_of, pa.list_(pa.int32())), pa.array(back, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, digests and, ``with_ids``, the ids and the decoded text.

    One row per input row, in one narrow pass without a shuffle. Null and empty texts have
    no ids (the digests are those of nothing); null ids stay null; repeated rows repeat;
    other columns are not read. Texts are whole: a long one is worked off word by word,
    and a word of any length in linear space. The file at ``tokenizer_path`` must exist
    on every executor.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = DIGEST_SCHEMA + (", ids array<int>, decoded string" if with_ids else "")
    return map_arrow(slim, _digests(tokenizer_path, with_ids), schema)


def decode_documents(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text for rows of ids; unknown ids are left out, null ids give an empty text."""

    @F.pandas_udf("string")
    def told(ids: pd.Series) -> pd.Series:
        bpe = chunk_cache(tokenizer_path).bpe
        return ids.map(lambda x: bpe.decode([] if x is None else list(x)))

    return encoded.select(F.col(id_col).alias("doc_id"), told(F.col(ids_col)).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)

