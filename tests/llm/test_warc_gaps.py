"""Records and gaps tile an archive, wherever the bounds of the byte ranges lie."""

import random
import zlib

import pytest

from foliant.llm import warc
from foliant.llm.files import Ranged


@pytest.mark.parametrize("gzip", [True, False])
def test_records_and_gaps_tile_the_file(tmp_path, gzip):
    def member(i):
        data = warc.record(i, "http://x", bytes(random.Random(i).randrange(32, 127) for _ in range(400)), None)
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        return z.compress(data) + z.flush() if gzip else data

    parts = [member(i) for i in range(9)]
    starts = [sum(map(len, parts[:i])) for i in range(10)]
    for i in (0, 3, 4, 5, 8):
        parts[i] = b"#" * len(parts[i])  # one at each end, and a run longer than a range
    path = tmp_path / ("a.warc.gz" if gzip else "a.warc")
    path.write_bytes(b"".join(parts))
    for size in (10**9, starts[3], starts[3] - 1, starts[1], 300, 64):  # starts[3]: damage begins right at a bound
        file = Ranged(str(path))
        events = sorted(e[1:3] + e[:1] for first in range(0, file.size, size) for e in warc.salvaged(file, first, first + size, gzip))
        assert [(a, b) for a, b, kind in events if kind == "gap"] == [(0, starts[1]), (starts[3], starts[6]), (starts[8], starts[9])], size
        assert sum(b - a for a, b, _ in events) == file.size and all(x[1] == y[0] for x, y in zip(events, events[1:]))
