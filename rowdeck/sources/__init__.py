from rowdeck.sources.files import (
    parse_dicts,
    parse_numbers,
    parse_tokens,
    read_binary,
    read_dicts,
    read_lines,
    read_numbers,
    read_tokens,
)
from rowdeck.sources.generate import integers, sequence, uniforms
from rowdeck.sources.images import read_images
from rowdeck.sources.memory import from_items, from_numpy, from_pandas
from rowdeck.sources.positions import number_parquet, number_rows, number_text

__all__ = [
    "from_items",
    "from_numpy",
    "from_pandas",
    "integers",
    "number_parquet",
    "number_rows",
    "number_text",
    "parse_dicts",
    "parse_numbers",
    "parse_tokens",
    "read_binary",
    "read_dicts",
    "read_images",
    "read_lines",
    "read_numbers",
    "read_tokens",
    "sequence",
    "uniforms",
]
