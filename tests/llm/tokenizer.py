import base64
from functools import lru_cache
from pathlib import Path

import tiktoken

from sortament.llm.mixing import PATTERN


@lru_cache
def _load(path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(path, text):
    encoding = _load(path)
    ids = encoding.encode_ordinary(text)
    assert encoding.decode(ids) == text
    return ids
