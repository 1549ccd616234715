"""annolith.sources"""
