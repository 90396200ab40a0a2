"""Roles of the tables that operators take, and the values they share.

* ``extents(image_id, start, length, state, file_offset)``: runs of an image's bytes
* ``blocks(image_id, block_idx, state, file_offset)``: one fixed-size unit each
* ``layers(chain_id, depth, block_idx, state, payload)``: depth 0 is the top
* ``refs(src, cluster_idx)`` and ``refcounts(cluster_idx, stored)``
* ``dirty(bitmap, granule)``; ``snapshots(ordinal, id, name)``

Zero and hole are states of their own: neither is a null.
"""

from __future__ import annotations

HOLE, ZERO, DATA, ZERO_AT, HOLE_AT = "hole", "zero", "data", "zero_at", "hole_at"
#: States that say where in the file they lie.
PLACED = (DATA, ZERO_AT, HOLE_AT)
#: Codes of the states in the record format; fixed values.
STATE_CODES = {HOLE: 0, ZERO: 1, DATA: 2, ZERO_AT: 3, HOLE_AT: 4}
#: (present, zero, data) of each state; fixed values.
STATE_FLAGS = {DATA: (True, False, True), ZERO: (True, True, False), ZERO_AT: (True, True, False), HOLE: (False, True, False), HOLE_AT: (False, True, False)}
MAX_CHAIN_DEPTH = 16
BLOCK = 65536
