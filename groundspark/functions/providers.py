"""What remote models have to offer, and calls of them that may fail."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd


class Embedder(Protocol):
    """Batches of ``(id, text)``, under the caller's names, to batches of ``(id, embedding)``; all vectors of one length."""

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]: ...


class Generator(Protocol):
    """Batches of ``(query_id, prompt)`` to batches of ``(query_id, answer)``."""

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]: ...


class PdfPages(Protocol):
    """Batches of ``(doc_id, content)`` to batches of ``(doc_id, page_no, text)``; called with one file at a time."""

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]: ...


def guarded(provider: Callable, instead: Callable[[pd.DataFrame], pd.DataFrame], given: list[str]) -> Callable:
    """A ``mapInPandas`` function: ``provider`` on the columns ``given`` of each batch; ``instead`` makes the rows of a batch on which it raises.

    Only the provider's own failures are caught, each with a warning in the task's log.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                made = list(provider(iter([batch[given]])))
            except Exception as error:
                logging.getLogger(__name__).warning("provider failed, local rows instead of %d: %s", len(batch), error)
                made = [instead(batch)]
            yield from made

    return run
