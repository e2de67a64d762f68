"""The work of a source's windows grows with its requests, not with requests times window."""

import random
import time
from types import SimpleNamespace

from flowquarry.operators.sessions_l7 import _Source


def test_tenants_are_counted_as_they_come_and_go():
    rng, source, seen, t = random.Random(2), _Source(), [], 0
    for _ in range(3000):
        t += rng.choice((0, 1, 200_000, 3_000_000, 31_000_000))
        seen.append((t, f"t{rng.randrange(9)}"))
        assert source.tenants_within(seen[-1][1], t, 30) == len({x for at, x in seen if t - at <= 30_000_000})


def test_a_dense_window_is_not_read_again_for_each_request():
    source, began = _Source(), time.monotonic()
    for k in range(60_000):
        source.verdict(SimpleNamespace(t_us=k, metadata=False, sign_in=0, seen_tenant=f"t{k % 5}", bots=[], injections=[], files=[], dst_ip="10.0.0.1", low_path="/"))
    assert time.monotonic() - began < 5
