"""Operators over bars: sessions, windows, neighbours, signals, backtest, baselines, ledger, journal."""
