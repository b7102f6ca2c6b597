"""Encodings: grammar x vocabulary x special tokens x normalization x id offset, and the registry of names."""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .functions.bpe import Merger
from .functions.grammars import GRAMMARS, java_pattern

#: Limits of a vocabulary, which also bound what is broadcast: 2**18 tokens of 255 bytes, 4096 specials of 64 bytes.
MAX_TOKENS, MAX_TOKEN_BYTES = 1 << 18, 255
MAX_SPECIALS, MAX_SPECIAL_BYTES = 4096, 64
END_OF_TEXT = ("<|endoftext|>", "<|end_of_text|>", "</s>")


class BadVocabulary(ValueError):
    """A vocabulary or special table that no encoding can be made of."""


def check_ranks(ranks: Mapping[bytes, int]) -> None:
    n = len(ranks)
    if not 1 <= n <= MAX_TOKENS:
        raise BadVocabulary(f"{n} tokens; 1 to {MAX_TOKENS} are allowed")
    if any(not 1 <= len(b) <= MAX_TOKEN_BYTES for b in ranks):
        raise BadVocabulary(f"a token has no bytes or more than {MAX_TOKEN_BYTES}")
    if sorted(ranks.values()) != list(range(n)):
        raise BadVocabulary("ranks must be 0..n-1, each once")
    if missing := [i for i in range(256) if bytes([i]) not in ranks]:
        raise BadVocabulary(f"byte {missing[0]} is no token, so not every text could be encoded")


def check_specials(specials: Mapping[str, int]) -> None:
    if len(specials) > MAX_SPECIALS:
        raise BadVocabulary(f"{len(specials)} special tokens; {MAX_SPECIALS} are allowed")
    for s, i in specials.items():
        if not 1 <= len(s.encode()) <= MAX_SPECIAL_BYTES:
            raise BadVocabulary(f"special token {s!r} has no bytes or more than {MAX_SPECIAL_BYTES}")
        if not 0 <= i < 2**31:
            raise BadVocabulary(f"special token {s!r} has id {i}")


@dataclass(frozen=True, eq=False)
class Encoding:
    """An immutable encoding. Its merge table reaches executors by broadcast (its size is bounded by the limits above)."""

    name: str
    grammar: str
    ranks: Mapping[bytes, int] = field(repr=False)
    specials: Mapping[str, int] = field(default_factory=dict, repr=False)
    nfc: bool = False
    id_offset: int = 0

    def __post_init__(self) -> None:
        java_pattern(self.grammar)
        check_ranks(self.ranks)
        check_specials(self.specials)

    @functools.cached_property
    def fingerprint(self) -> str:
        """Names the merge table in a worker's memory."""
        h = hashlib.sha256(f"{self.id_offset}".encode())
        for b, r in sorted(self.ranks.items(), key=lambda x: x[1]):
            h.update(len(b).to_bytes(1) + b)
        for s, i in self.special_items:
            h.update(f"{i}:{len(s)}:{s}".encode())
        return h.hexdigest()

    @functools.cached_property
    def special_items(self) -> list[tuple[str, int]]:
        """Special tokens in order of id: where several begin at one place, the lowest id wins."""
        return sorted(self.specials.items(), key=lambda x: x[1])

    # -- scalar facts ---------------------------------------------------------------------------

    @property
    def vocab_size(self) -> int:
        return len(self.ranks)

    @property
    def n_vocab(self) -> int:
        """Largest id + 1, special tokens and offset included."""
        return max(len(self.ranks) + self.id_offset, *(i + 1 for i in self.specials.values())) if self.specials else len(self.ranks) + self.id_offset

    @property
    def max_token_value(self) -> int:
        return self.n_vocab - 1

    @property
    def special_tokens_set(self) -> set[str]:
        return set(self.specials)

    @property
    def eot_token(self) -> int:
        for s in END_OF_TEXT:
            if s in self.specials:
                return self.specials[s]
        raise KeyError(f"{self.name} has no end-of-text token")

    def encode_single_token(self, token: str | bytes) -> int:
        raw = token.encode() if isinstance(token, str) else token
        if raw in self.ranks:
            return self.ranks[raw] + self.id_offset
        for s, i in self.specials.items():
            if s.encode() == raw:
                return i
        raise KeyError(token)

    def decode_single_token_bytes(self, token_id: int) -> bytes:
        if not self.known_id(token_id):
            raise KeyError(token_id)
        m = self.merger
        return m.bytes[m.starts[token_id] : m.starts[token_id + 1]].tobytes()

    def known_id(self, token_id: int) -> bool:
        return 0 <= token_id < len(self.merger.is_known) and bool(self.merger.is_known[token_id])

    def is_special_token(self, token_id: int) -> bool:
        return token_id in self.specials.values()

    def token_byte_values(self) -> list[bytes]:
        return sorted(self.ranks)

    @functools.cached_property
    def merger(self) -> Merger:
        return Merger(dict(self.ranks), self.id_offset, dict(self.specials))

    # -- on a cluster ---------------------------------------------------------------------------

    def tables(self, spark: SparkSession) -> DataFrame:
        """The vocabulary as a dimension table (id, bytes, len, special)."""
        rows = [(r + self.id_offset, bytes(b), len(b), False) for b, r in self.ranks.items()] + [(i, s.encode(), len(s.encode()), True) for s, i in self.specials.items()]
        return spark.createDataFrame(rows, "id int, bytes binary, len int, special boolean")

    def on_workers(self, spark: SparkSession):
        """A function that gives the Merger in a worker (built there once)."""
        sc = spark.sparkContext
        kept = _BROADCASTS.get(self.fingerprint)
        if kept is None or kept[0] != sc.applicationId:
            kept = _BROADCASTS[self.fingerprint] = (sc.applicationId, sc.broadcast((dict(self.ranks), self.id_offset, dict(self.specials))))
        return functools.partial(_in_worker, self.fingerprint, kept[1])


_BROADCASTS: dict[str, tuple] = {}
_MERGERS: dict[str, Merger] = {}


def _in_worker(fingerprint: str, table) -> Merger:
    if fingerprint not in _MERGERS:
        _MERGERS[fingerprint] = Merger(*table.value)
    return _MERGERS[fingerprint]


# -- names ------------------------------------------------------------------------------------

#: name: (grammar, vocabulary file stem, special file stem, NFC)
NAMED = {
    "cl100k_base": ("cl100k", "cl100k", "cl100k", False),
    "o200k_base": ("o200k", "o200k", "o200k", False),
    "o200k_harmony": ("o200k", "o200k", "o200k_harmony", False),
    "llama4": ("o200k", "llama4", "llama4", False),
    "llama3": ("llama3", "llama3", "llama3", False),
    "qwen3": ("qwen", "qwen3", "qwen3", True),
    "qwen2.5": ("qwen", "qwen3", "qwen3", True),
    "qwen": ("qwen", "qwen3", "qwen3", True),
}
# Model names and the encodings they use.
MODELS = {
    "gpt-4o": "o200k_base", "gpt-4o-mini": "o200k_base", "o1": "o200k_base", "o3": "o200k_base",
    "gpt-4": "cl100k_base", "gpt-4-turbo": "cl100k_base", "gpt-3.5-turbo": "cl100k_base", "gpt-oss": "o200k_harmony",
    "qwen3": "qwen3", "qwen2.5": "qwen3", "qwen2": "qwen3",
    "llama-3.3": "llama3", "llama-3.2": "llama3", "llama-3.1": "llama3", "llama-3": "llama3", "llama3": "llama3", "meta-llama-3": "llama3",
}
DATA_HOME = "BRINDLE_DATA"


def data_home() -> str:
    """Where imported encodings lie unless a folder is given."""
    return os.environ.get(DATA_HOME) or os.path.join(os.environ.get("XDG_CACHE_HOME") or os.path.expanduser("~/.cache"), "brindle")


@functools.lru_cache(maxsize=32)
def get_encoding(name: str, data_dir: str = "") -> Encoding:
    """The encoding of a name: its files in data_dir (by default in data_home()), each name loaded once."""
    from .sources.files import load_encoding

    return load_encoding(name, data_dir or data_home())


def encoding_name_for_model(model: str) -> str:
    """The longest known model name that is the model's, or is followed in it by - or a full stop."""
    m = model.lower().rpartition("/")[2]
    fits = [k for k in MODELS if m == k or m.startswith((k + "-", k + "."))]
    if not fits:
        raise KeyError(f"unknown model {model!r}: give an encoding's name to get_encoding(), or import its tokenizer")
    return MODELS[max(fits, key=len)]


def encoding_for_model(model: str, data_dir: str = "") -> Encoding:
    return get_encoding(encoding_name_for_model(model), data_dir)


def byte_encoding(grammar: str = "llama3", merges: tuple[bytes, ...] = (), name: str = "bytes", **more) -> Encoding:
    """The 256 single bytes, and merges after them in order of rank: needs no file."""
    if grammar not in GRAMMARS:
        raise KeyError(grammar)
    ranks = {bytes([i]): i for i in range(256)}
    ranks |= {m: 256 + i for i, m in enumerate(merges)}
    return Encoding(name, grammar, ranks, **more)
