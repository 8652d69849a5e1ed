"""What test modules share; not a fixture, so any module can import it."""

from datetime import datetime

BASE = datetime(2024, 1, 1, 10, 0, 0)
