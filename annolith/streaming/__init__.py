"""annolith.streaming"""
