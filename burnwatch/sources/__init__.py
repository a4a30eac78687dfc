"""Inputs and outputs: event rollup, page files, record normaliser, snapshot store, time ranges."""
