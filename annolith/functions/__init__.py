"""annolith.functions"""
