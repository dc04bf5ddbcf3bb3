"""A registry of named datasets: tables that any Spark reader can open. The usual example
tables are registered by name and read from the folder in the option ``datasets_dir``."""

from __future__ import annotations

import functools
from typing import NamedTuple

from verbena.frame import Frame, session
from verbena.options import get_option
from verbena.operators.tibble import column_to_rownames


class Metadata(NamedTuple):
    """What is known of a dataset; ``source`` is a path, ``index``: the first column names rows."""

    descr: str = ""
    ref: str = ""
    index: bool = False
    source: str | None = None


# The names of the usual example tables.
NAMES = (
    "airlines airports airquality anscombe band_instruments band_instruments2 band_members billboard chickweight cms_patient_care cms_patient_experience construction diamonds economics "
    "economics_long faithful faithfuld fish_encounters flights gss_cat household iris luv_colours midwest mpg msleep mtcars planes population presidential relig_income seals smith starwars "
    "state_abb state_division state_region storms table1 table2 table3 table4a table4b table5 toothgrowth txhousing us_rent_income warpbreaks weather who who2 world_bank_pop"
).split()

registry: dict[str, Metadata] = {name: Metadata(index=name in ("mtcars", "storms")) for name in NAMES}


def descr_datasets(*names: str) -> dict[str, Metadata]:
    """What is known of the datasets named, or of all."""
    return {k: v for k, v in registry.items() if not names or k in names}


def add_dataset(name: str, meta: Metadata) -> None:
    """Register a dataset."""
    registry[name] = meta
    load_dataset.cache_clear()


@functools.lru_cache(maxsize=64)
def load_dataset(name: str) -> Frame:
    """A dataset as a lazy frame."""
    if name not in registry:
        raise ValueError(f"no dataset {name!r}")
    meta = registry[name]
    source = meta.source or (f"{get_option('datasets_dir')}/{name}.csv.gz" if get_option("datasets_dir") else None)
    if source is None:
        raise FileNotFoundError(f"dataset {name!r} has no source; set the option datasets_dir or register one")
    from verbena.sources import read

    frame = read(source, session=session())
    return column_to_rownames(frame, frame.columns[0]) if meta.index else frame


def __getattr__(name: str) -> Frame:
    if name.startswith("_"):
        raise AttributeError(name)
    return load_dataset(name.lower())
