"""BPE encoding and decoding by streaming transducers with bounded lookahead.

The vocabulary file (a path, a parameter) holds a byte-level BPE with its normalizer, its pattern of words, its word end and its decoder, if it has them; encoding
follows the file: special tokens' strings first, then the normalizers, cutting into words, bytes, merges. Files with other steps than these are errors.
The library knows letters and numbers up to Unicode 16, small letters up to Unicode 17 and normal forms up to Unicode 9; what differs here is listed below.

A text is read in pieces of about ``PIECE`` characters that end before white space, and its ids are put out piece by piece. The transducer reads the symbols of a
word in windows. In a window it merges as the merge list says, and emits a token
once it is stable: once at least ``lookahead`` symbols follow it in the window, or the word has ended. The lookahead is
computed from the merge list: a merge (x, y) depends on what may take y away first, a merge of lower rank whose left part is on the right
edge of y, and so on; the longest such chain, in symbols, suffices. What is left of the window is read again with the next symbols, so memory is
constant for a word of any length. Words that come again are looked up in a table of bounded size.

Decoding is a state machine that is fed ids, in as many calls as one likes. Files without a decoder join the tokens' strings by one space: the state is
whether a token came before. Byte-level decoders map tokens to bytes, and the state holds back the bytes of an unfinished character.

Defined results: null is the empty text; it has no tokens and decodes to the empty text. Ids beyond the vocabulary are passed over. Rows that repeat are encoded
alike; texts are encoded whole at any length; an empty table gives an empty table; other columns are kept (``encode_texts``) or left out (``code_digests``).
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.session import fresh

PIECE, STEP = 1 << 16, 4096
#: How byte-level files without a pattern of their own cut a text.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and numbers that came after Unicode 16, first and last.
LATER = (
    (0x558, 0x558), (0x58b, 0x58c), (0x88f, 0x88f), (0xc5c, 0xc5c), (0xcdc, 0xcdc), (0x208f, 0x208f), (0x209d, 0x209f), (0xa7ce, 0xa7cf), (0xa7d2, 0xa7d2), (0xa7d4, 0xa7d4),
    (0xa7dd, 0xa7dd), (0xa7e2, 0xa7e2), (0xa7f1, 0xa7f1), (0xab6c, 0xab6d), (0x107bb, 0x107bf), (0x10940, 0x10959), (0x10ec5, 0x10ec7), (0x10ed9, 0x10eee), (0x11b0a, 0x11b0a),
    (0x11db0, 0x11ddb), (0x11de0, 0x11de9), (0x11df1, 0x11df1), (0x1246f, 0x1246f), (0x12475, 0x1247f), (0x12550, 0x12686), (0x16ea0, 0x16eb8), (0x16ebb, 0x16ed3), (0x16ff2, 0x16ff3),
    (0x16ff4, 0x16ff6), (0x187f8, 0x187ff), (0x18cd6, 0x18cda), (0x18d09, 0x18d20), (0x18d80, 0x18df2), (0x18e00, 0x19191), (0x191a0, 0x191d2), (0x1b123, 0x1b128), (0x1b168, 0x1b168),
    (0x1d6a6, 0x1d6a6), (0x1df1f, 0x1df24), (0x1df2b, 0x1df81), (0x1df90, 0x1df96), (0x1dfcd, 0x1dfff), (0x1e6c0, 0x1e6de), (0x1e6e0, 0x1e6e2), (0x1e6e4, 0x1e6e5), (0x1e6e7, 0x1e6ed),
    (0x1e6f0, 0x1e6f4), (0x1e6fe, 0x1e6ff), (0x2b73a, 0x2b73f), (0x2b81e, 0x2b81e), (0x2cea2, 0x2cead), (0x323b0, 0x33479), (0x3d000, 0x3fc3f),
)
#: Capitals of Unicode 16 and 17, first, last and the first's small letter.
CAPITALS = (
    (0x1c89, 0x1c89, 0x1c8a), (0xa7cb, 0xa7cb, 0x264), (0xa7cc, 0xa7cc, 0xa7cd), (0xa7ce, 0xa7ce, 0xa7cf), (0xa7d2, 0xa7d2, 0xa7d3), (0xa7d4, 0xa7d4, 0xa7d5), (0xa7da, 0xa7da, 0xa7db),
    (0xa7dc, 0xa7dc, 0x19b), (0x10d50, 0x10d65, 0x10d70), (0x16ea0, 0x16eb8, 0x16ebb),
)
#: Marks and parts of letters that came after Unicode 9, first and last: the library's normal forms leave them where they are.
UNMARKED = (
    (0x7fd, 0x7fd), (0x898, 0x89f), (0x8ca, 0x8d3), (0x9fe, 0x9fe), (0xc3c, 0xc3c), (0xd3b, 0xd3c), (0xeba, 0xeba), (0x1715, 0x1715), (0x1abf, 0x1ace), (0x1df6, 0x1dfa),
    (0xa82c, 0xa82c), (0x10d24, 0x10d27), (0x10eab, 0x10eac), (0x10efd, 0x10eff), (0x10f46, 0x10f50), (0x10f82, 0x10f85), (0x11070, 0x11070), (0x1133b, 0x1133b), (0x1145e, 0x1145e),
    (0x11839, 0x1183a), (0x11930, 0x11930), (0x11938, 0x11938), (0x1193d, 0x1193e), (0x11943, 0x11943), (0x119e0, 0x119e0), (0x11a34, 0x11a34), (0x11a47, 0x11a47), (0x11a99, 0x11a99),
    (0x11d42, 0x11d42), (0x11d44, 0x11d45), (0x11d97, 0x11d97), (0x11f41, 0x11f42), (0x16ff0, 0x16ff1), (0x1e08f, 0x1e08f), (0x1e130, 0x1e136), (0x1e2ae, 0x1e2ae), (0x1e2ec, 0x1e2ef),
    (0x1e4ec, 0x1e4ef),
)
SMALL = {a + i: chr(c + i) for a, b, c in CAPITALS for i in range(b - a + 1)} | {ord("Σ"): "σ"}
LATER_SET, UNMARKED_SET = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in x) for x in (LATER, UNMARKED))
UNMARKED_IN = re.compile(f"([{UNMARKED_SET}]+)")


#: Only texts with one of these can hold a character of the lists above.
RARE = re.compile("[\u03a3\u0558-\U0010ffff]")


def lower(text: str) -> str:
    """Each letter on its own: a sigma at a word's end is like any other."""
    return text.translate(SMALL).lower() if RARE.search(text) else text.lower()


def normal_form(kind: str, text: str) -> str:
    if text.isascii():
        return text
    if RARE.search(text) and UNMARKED_IN.search(text):
        return "".join(x if k % 2 else unicodedata.normalize(kind, x) for k, x in enumerate(UNMARKED_IN.split(text)))
    return text if unicodedata.is_normalized(kind, text) else unicodedata.normalize(kind, text)


def byte_characters() -> list[str]:
    """The printable character of each byte in byte-level vocabularies: itself, or the next one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, after = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(after))
        after += b not in plain
    return out


class Transducer:
    def __init__(self, merges: list[tuple[str, str]], vocab: dict[str, int], end: str):
        self.vocab, self.end = vocab, end
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.size = {}  # symbols of each token
        self.lookahead = self._lookahead(merges)
        self.window = max(256, 4 * self.lookahead)

    def _length(self, token: str) -> int:
        return len(token.removesuffix(self.end))

    def _lookahead(self, merges) -> int:
        edge: dict[str, str] = {}  # the right part of a merged token
        reach: dict[str, int] = {}  # by left part: the longest chain of merges so far that begin with it
        most = 0
        for x, y in merges:
            far, s = 0, y
            while s is not None:
                far = max(far, reach.get(s, 0))
                s = edge.get(s)
            depth = self._length(y) + far
            reach[x] = max(reach.get(x, 0), depth)
            edge.setdefault(x + y, y)
            most = max(most, depth)
        return most + 1

    def _merge(self, symbols: list[str]) -> list[str]:
        if len(symbols) > 32:
            return self._merge_many(symbols)
        get, far = self.rank.get, len(self.rank)
        ranks = [get(pair, far) for pair in zip(symbols, symbols[1:])]  # noqa: B905
        while ranks and (r := min(ranks)) < far:
            i = ranks.index(r)
            del ranks[i]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            if i:
                ranks[i - 1] = get((symbols[i - 1], symbols[i]), far)
            if i < len(ranks):
                ranks[i] = get((symbols[i], symbols[i + 1]), far)
        return symbols

    def _merge_many(self, symbols: list[str]) -> list[str]:
        """The same with a heap of the pairs, the first of the lowest rank on top."""
        rank, n = self.rank, len(symbols)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is None or j < 0 or rank.get((symbols[i], symbols[j])) != r:
                continue  # one of the two was merged before
            symbols[i] += symbols[j]
            symbols[j] = None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (k := before[i]) >= 0 and (r := rank.get((symbols[k], symbols[i]))) is not None:
                heapq.heappush(heap, (r, k))
        return [x for x in symbols if x is not None]

    def tokens(self, symbols: Iterable[str]) -> Iterator[str]:
        """The tokens of one word, whose last symbol has the word end."""
        source, held = iter(symbols), []
        while True:
            ended = False
            while len(held) < self.window:
                s = next(source, None)
                if s is None:
                    ended = True
                    break
                held.append(s)
            made = self._merge(list(held))
            if ended:
                yield from made
                return
            stable, used = len(held) - self.lookahead, 0
            for token in made:
                n = self._length(token)
                if used + n > stable:
                    break
                used += n
                yield token
            held = held[used:]


def _normalizer(spec: dict | None, no_spaces: bool) -> list[Callable[[str], str]]:
    import regex

    kind = spec and spec["type"]
    if kind is None:
        return []
    if kind == "Sequence":
        return [f for part in spec["normalizers"] for f in _normalizer(part, no_spaces)]
    if kind in ("NFC", "NFD", "NFKC", "NFKD"):
        return [lambda text: normal_form(kind, text)]
    if kind == "Lowercase":
        return [lower]
    if kind == "Replace":
        if no_spaces and spec["pattern"] == {"Regex": r"\s+"} and spec["content"] == " ":
            return []
        pattern = regex.compile(spec["pattern"]["Regex"] if "Regex" in spec["pattern"] else regex.escape(spec["pattern"]["String"]))
        return [lambda text: pattern.sub(lambda _: spec["content"], text)]
    raise ValueError(f"normalizer {kind} is not known")


def _word_pattern(spec: dict) -> str:
    parts = spec["pretokenizers"] if spec["type"] == "Sequence" else [spec]
    last = parts[-1]
    if last["type"] != "ByteLevel" or last.get("add_prefix_space"):
        raise ValueError("the file does not cut into bytes")
    if len(parts) == 1 and last.get("use_regex", True):
        return BYTE_LEVEL
    if len(parts) == 2 and parts[0]["type"] == "Split" and not last.get("use_regex", True) and parts[0]["behavior"] == "Removed" and parts[0]["invert"]:
        return parts[0]["pattern"]["Regex"]
    raise ValueError("the file cuts words in a way that is not known")


class Tokenizer:
    """Encodes and decodes by a vocabulary file; ``remember`` bounds the table of known words."""

    def __init__(self, path: str, remember: int = 80_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("the file is no plain BPE")
        vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.transducer = Transducer([tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], vocab, self.end)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        text_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.text_of = [text_of.get(i) for i in range(max(text_of) + 1)]
        self.name_of = [str(i) for i in range(len(self.text_of))]
        self.characters = byte_characters()
        self.byte_of = {c: b for b, c in enumerate(self.characters)}
        if (spec.get("decoder") or {"type": None})["type"] not in (None, "ByteLevel"):
            raise ValueError("the file's decoder is not known")
        self.by_bytes = spec.get("decoder") is not None
        pattern = _word_pattern(spec["pre_tokenizer"])
        self.cut = regex.compile(pattern)
        # where no word holds white space or looks around, what white space is makes no difference
        plain = "(?" not in pattern and not self.cut.search("".join(regex.findall(r"\s", "".join(map(chr, range(0x3001))))))
        self.normalizers = _normalizer(spec["normalizer"], plain)
        for c in "LN":
            pattern = pattern.replace(rf"\p{{{c}}}", rf"[\p{{{c}}}--[{LATER_SET}]]")
        self.cut_later = regex.compile(pattern, regex.V1)
        self.has_later = regex.compile(f"[{LATER_SET}]").search
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.break_ = regex.compile(r"(?<=\S)(?=[ \n])")
        self.remember, self.known, self.older = remember, {}, {}

    def _word(self, word: str) -> Iterator[int]:
        """The ids of a word, one after the other."""
        raw, vocab = word.encode(), self.transducer.vocab
        last = self.characters[raw[-1]] + self.end
        if len(raw) <= self.transducer.window:  # one window
            return map(vocab.__getitem__, self.transducer._merge([*map(self.characters.__getitem__, raw[:-1]), last]))
        return (vocab[t] for t in self.transducer.tokens(chain((self.characters[b] for b in raw[:-1]), [last])))

    def _learned(self, word: str) -> list[int]:
        found = self.older.get(word)
        if found is None:
            found = list(self._word(word))
        if len(self.known) >= self.remember:
            self.older, self.known = self.known, {}
        self.known[word] = found
        return found

    def _pieces(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PIECE:
            m = self.break_.search(text, at + PIECE)
            if m is None:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def ids(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, in lists."""
        for piece in self._pieces(text):
            for part in self.cut_special.split(piece) if self.cut_special and "<|" in piece else (piece,):
                if part in self.special:
                    yield [self.special[part]]
                    continue
                for normal in self.normalizers:
                    part = normal(part)
                words = (self.cut if not RARE.search(part) or not self.has_later(part) else self.cut_later).findall(part)
                get = self.known.get
                found = [get(w) for w in words]
                if None in found:
                    new = dict.fromkeys([w for w, f in zip(words, found) if f is None])  # noqa: B905
                    if len(max(new, key=len)) > 64:
                        yield from self._with_long_words(words)
                        continue
                    for w in new:
                        new[w] = self._learned(w)
                    found = [f or new[w] for w, f in zip(words, found)]  # noqa: B905
                yield list(chain.from_iterable(found))

    def _with_long_words(self, words: list[str]) -> Iterator[list[int]]:
        for word in words:
            if len(word) <= 64:
                yield self.known.get(word) or self._learned(word)
            else:
                rest = self._word(word)
                while some := list(islice(rest, STEP)):
                    yield some

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.ids(text)))

    def decoder(self) -> Decoder:
        return Bytes(self) if self.by_bytes else Words(self)

    def decode(self, ids: Iterable[int]) -> str:
        state = self.decoder()
        return state.feed(list(ids)) + state.end()


class Decoder:
    """Fed with ids it gives the text that is certain by now."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.text_of = tokenizer, tokenizer.text_of

    def tokens(self, ids: list[int]) -> list[str]:
        text_of = self.text_of
        if ids and (min(ids) < 0 or max(ids) >= len(text_of)):
            ids = [i for i in ids if 0 <= i < len(text_of)]
        found = [text_of[i] for i in ids]
        return [t for t in found if t is not None] if None in found else found

    def feed(self, ids: list[int]) -> str:
        raise NotImplementedError

    def end(self) -> str:
        return ""


class Words(Decoder):
    """Tokens' strings, joined by one space."""

    between = ""

    def feed(self, ids: list[int]) -> str:
        tokens = self.tokens(ids)
        if not tokens:
            return ""
        text, self.between = self.between + " ".join(tokens), " "
        return text


class Bytes(Decoder):
    """Bytes become characters once they are whole; word ends, if the file has them, become spaces."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__(tokenizer)
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        t, out = self.tokenizer, []
        for token in self.tokens(ids):
            ended = bool(t.end) and token.endswith(t.end)
            raw = token.encode() if token in t.special else bytes(t.byte_of[c] for c in (token.removesuffix(t.end) if t.end else token))
            out.append(self.state.decode(raw, ended) + " " * ended)
        return "".join(out)

    def end(self) -> str:
        return self.state.decode(b"", True)


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One for each worker and file."""
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


CODES = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def encode_texts(docs: DataFrame, path: str, *, text_col: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the token ids as array<int> in column ``into``."""
    name = fresh(into, docs.columns)

    def run(batches):
        t = tokenizer(path)
        for batch in batches:
            ids = [t.encode(x or "") for x in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))]))


def code_digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id with n_tokens and the digests of its ids and of what the decoder makes of them."""

    def run(batches):
        t = tokenizer(path)
        names = t.name_of
        for batch in batches:
            rows = []
            for x in batch.column(1):
                count, ids, text, decoder = 0, hashlib.sha256(), hashlib.sha256(), t.decoder()
                for some in t.ids(x.as_py() or ""):
                    if some:
                        ids.update((" " * bool(count) + " ".join([names[i] for i in some])).encode())
                        text.update(decoder.feed(some).encode())
                        count += len(some)
                text.update(decoder.end().encode())
                rows.append((count, ids.hexdigest(), text.hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[id_col, *CODES.names])

    schema = T.StructType([docs.schema[id_col], *CODES.fields])
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
