"""Tables that cut lineage and checks of size, as the whole library uses them."""

from ..workspace import BROADCAST_MB, Workspace, shared_root, small_enough

__all__ = ["BROADCAST_MB", "Workspace", "shared_root", "small_enough"]
