"""Named queries over the adapter views."""

from importlib import import_module

MODULES = [
    "q_conform",
    "q_dedup",
    "q_sessions",
    "q_activity",
    "q_spectrum",
    "q_tracking",
    "q_evidence",
    "q_bursts",
    "q_reports",
    "q_sources",
]


def load_all() -> None:
    from importlib.util import find_spec

    for name in MODULES:
        if find_spec(f"radiolake.plans.{name}"):
            import_module(f"radiolake.plans.{name}")
