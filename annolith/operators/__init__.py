"""annolith.operators"""
