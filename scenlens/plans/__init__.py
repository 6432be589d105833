"""The named results, each a function from input tables to a lazy DataFrame.

"""
