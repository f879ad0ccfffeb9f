"""What Python workers hold between tasks."""

from partita.llm import packing, shared
from partita.llm.shared import lean


def test_other_tasks_drop_what_packing_keeps():
    path = packing.vocabulary_path()
    kept = packing.encoder(path)
    assert list(lean(iter, keep=True)([1, 2])) == [1, 2] and packing.encoder(path) is kept
    assert list(lean(iter)([1, 2])) == [1, 2] and not shared.KEPT
