"""Syntax tree, parser, planner and plan inspection."""
