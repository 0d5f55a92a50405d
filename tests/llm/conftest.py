"""Tests of this folder work on tables of a few rows, whose shuffle files need no cleaning up between steps."""

from fareloom.llm import common

common.TIDY = False
